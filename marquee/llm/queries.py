"""The registered queries of the operators for training text, and their SQL.

Each applies its operator, with the parameters meant for production, to a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import (
    credentials,
    edit_counts,
    embeddings,
    extraction,
    lexical,
    mixing,
    quality,
    sentencepieces,
    simhash,
    suffix_dedup,
    toxicity,
    url_lists,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    field = quality.train(documents, _table(spark, sf_dir, "labels"))
    return quality.assess(documents, field)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits made up from its id: a cut, an addition, a replacement."""
    length = F.length(F.coalesce("text", F.lit("")))
    changes = (
        (40, F.lit("")),
        (0, F.concat(F.lit(" Added by "), F.coalesce("source", F.lit("?")), F.lit(": don't, 1234.\n"))),
        (7, F.lit("naïve 漢字")),
    )
    edits = [
        F.struct(
            F.pmod(F.xxhash64(F.lit(i), F.coalesce("doc_id", F.lit(-1).cast("long"))), length + 1).alias("start"),
            F.lit(removed).cast("long").alias("removed"),
            inserted.alias("inserted"),
        )
        for i, (removed, inserted) in enumerate(changes)
    ]
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", F.array(*edits).alias("edits"))
    return edit_counts.count_edited(documents)


#: Entries of a pattern by kind: digits of its MD5 that give the first day, days to spread
#: over, and action and days later of each.
LOGS = {
    "host": (1, 300, (("block", 0), ("remove", 100), ("block", 200))),
    "domain": (4, 365, (("allow", 0), ("block", 90), ("remove", 250))),
    "prefix": (7, 500, (("allow", 0), ("remove", 60))),
}


def url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list made from the hosts of ``pages``: pattern, action, at (day)."""
    pages = _table(spark, sf_dir, "pages").select(
        url_lists.host_of("url").alias("host"), F.get(url_lists.segments_of("url"), F.lit(0)).alias("first")
    )
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    found = (("host", F.col("host")), ("domain", domain), ("prefix", F.concat_ws("/", "host", "first")))
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern")) for kind, pattern in found))
    # Without a first segment the prefix would be the host itself.
    patterns = pages.where("host <> ''").select("first", F.inline(kinds)).where(
        "pattern <> '' AND (kind <> 'prefix' OR first IS NOT NULL)"
    )
    logs = F.lit(None)
    for kind, (digits, days, rows) in LOGS.items():
        day = F.expr(f"cast(conv(substr(md5(pattern), {digits}, 3), 16, 10) as bigint) % {days}")
        log = F.array(*(F.struct(F.lit(action).alias("action"), (day + later).alias("at")) for action, later in rows))
        logs = F.when(F.col("kind") == kind, log).otherwise(logs)
    return patterns.select("kind", "pattern").distinct().select("pattern", F.inline(logs))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against that list, fetched on a day made from its id."""
    pages = _table(spark, sf_dir, "pages").withColumn("fetched", F.pmod(F.col("page_id") * 7919, F.lit(730)))
    return url_lists.judge(pages, url_entries(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(sentencepieces.encode_decode(_table(spark, sf_dir, "documents")))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return linked.select(
        "vec_id",
        "n_links",
        F.col("component").alias("component_id"),
        (F.col("vec_id") == F.col("component")).alias("kept"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations that exceed a long are null here; the operator has them as decimals."""
    rows = whitening.components(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the owners; a source's documents of one language count as a repository."""
    documents = _table(spark, sf_dir, "documents").withColumn("repository", F.concat_ws("/", "source", "lang"))
    return credentials.digests(credentials.scan(documents, repository="repository"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    """Name to query."""
    return {
        query.__name__: query
        for query in (
            op1_quality_rules,
            op2_html_text,
            op3_edit_counts,
            op4_url_lists,
            op5_toxicity,
            op6_sentencepiece,
            op7_suffix_array,
            op8_simhash,
            op9_nn_descent,
            op10_mixing,
            op11_whitening,
            op12_lexical_search,
            op13_secrets,
            pipeline,
        )
    }


URLS = r"""captures AS (
  SELECT page_id, url, (page_id * 7919) % 730 AS fetched,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') AS host,
         list_filter(string_split(regexp_extract(url,
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)', 2), '/'), lambda x: x <> '') AS path
  FROM pages),
hosts AS (SELECT DISTINCT host AS pattern FROM captures WHERE host <> ''),
domains AS (
  SELECT DISTINCT regexp_extract(pattern, '([^.]+\.[^.]+)$', 1) AS pattern FROM hosts
  WHERE regexp_matches(pattern, '[^.]+\.[^.]+$')),
prefixes AS (SELECT DISTINCT host || '/' || path[1] AS pattern FROM captures WHERE host <> '' AND len(path) > 0),
planned AS (
  SELECT pattern, 1 AS digits, 300 AS days, unnest([0, 100, 200]) AS later, unnest(['block', 'remove', 'block']) AS action FROM hosts
  UNION ALL
  SELECT pattern, 4, 365, unnest([0, 90, 250]), unnest(['allow', 'block', 'remove']) FROM domains
  UNION ALL
  SELECT pattern, 7, 500, unnest([0, 60]), unnest(['allow', 'remove']) FROM prefixes),
entries AS (
  SELECT pattern, action, CAST('0x' || substr(md5(pattern), digits, 3) AS BIGINT) % days + later AS day FROM planned),
strongest AS (
  SELECT pattern, day, action FROM entries
  QUALIFY row_number() OVER (PARTITION BY pattern, day
    ORDER BY CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END DESC) = 1),
valid AS (
  SELECT pattern, action, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM strongest),
met AS (
  SELECT c.page_id, c.url, c.fetched, v.pattern, v.action,
         len(list_filter(string_split(v.pattern, '/'), lambda x: x <> '')) AS depth
  FROM captures c JOIN valid v
    ON v.action <> 'remove' AND v.since <= c.fetched AND (v.until IS NULL OR c.fetched < v.until)
   AND CASE WHEN contains(v.pattern, '/')
            THEN starts_with(c.host || '/' || array_to_string(c.path, '/') || '/', v.pattern || '/')
            ELSE c.host = v.pattern OR ends_with(c.host, '.' || v.pattern) END)"""


TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, for the operators that SQL can express."""
    return {
        "op4_url_lists": f"""WITH {URLS},
found AS (
  SELECT page_id, url, fetched, first(action ORDER BY depth DESC, length(pattern) DESC, pattern DESC) AS verdict,
         first(pattern ORDER BY depth DESC, length(pattern) DESC, pattern DESC) AS pattern, count(*) AS n_active
  FROM met GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched, coalesce(verdict, 'none') AS verdict, f.pattern,
       coalesce(n_active, 0) AS n_active
FROM captures c LEFT JOIN found f ON c.page_id = f.page_id AND c.url = f.url""",
        "op12_lexical_search": f"""WITH worded AS (SELECT doc_id, {TERMS} AS words FROM documents),
totals AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM worded WHERE len(words) > 0),
counted AS (
  SELECT doc_id, term, n, count(*) AS tf
  FROM (SELECT doc_id, unnest(words) AS term, len(words) AS n FROM worded) GROUP BY ALL),
weighted AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM counted, totals GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weighted USING (term), totals GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {lexical.TOP}""",
        "op10_mixing": r"""WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-' || text, '')) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(2.0::DOUBLE * source_size) OVER earlier, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM sources
  WINDOW earlier AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS goal,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (goal // source_size) * size + greatest(0, least(size, goal % source_size - start)) END AS BIGINT)
         AS taken
FROM placed""",
    }
