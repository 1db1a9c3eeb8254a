"""Mixing sources to target weights by a low-discrepancy schedule.

The slots of the mix are the points frac(i / golden ratio), i = 0, 1, ...: a point falls
into one source's share of [0, 1), so each stretch of slots holds every source close to its
share. The documents of a source, in the order of a digest of their key, are one stream of
words, cut into blocks of equal length. The slot that is a source's r-th takes its r-th
block, from the start again after a whole pass, until the source's target is met; the last
block is cut to meet it to the word.

Targets: sources in the order of their code points, null last, have ``weights`` in turn and
share ``share`` times all words; a target stops at ``most`` times its source's words, and
what is over goes to the others by weight, until none is above.

No step needs a source in one task: running sums and ranks are taken within buckets and
shifted by the sums of the buckets before. Only the table of sources, one row each, is
ordered in one task. Every row is mixed, repeated ones separately; null texts count as
empty, a null key is replaced by the text in the digest. Only DataFrame functions are used, and equal input gives equal output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
#: Words of a block.
BLOCK = 2048
#: Digits of the digest that name a bucket of a source's documents.
DIGITS = 3
#: Slots of a bucket, and parts of [0, 1) by which points meet shares.
CHUNK = 4096
CELLS = 1024


def place(key: str, text: str) -> Column:
    """A digest of the key, or of the text where that is null."""
    return F.md5(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("-"), F.col(text)), F.lit("")))


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size in words and the place in the shuffled order, written and read again."""
    rows = documents.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        words(text).alias("size"),
        place(key, text).alias("place"),
    )
    path = scratch_path(documents.sparkSession, "sizes")
    rows.write.parquet(path)
    return documents.sparkSession.read.schema(rows.schema).parquet(path)


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """number, source, source_size, target: a row for each source."""
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.lit(share) * F.sum("source_size").over(everything)
    # With the sources of the least caps for their weight at the cap, the rest at one level;
    # the largest of these levels is the one at which the targets meet the budget.
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("number") % len(weights) + 1))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("level", level)
    )
    return sources.select(
        "number",
        "source",
        "source_size",
        F.least("cap", F.max("level").over(everything) * F.col("weight")).alias("target"),
    )


def needed(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of sources with words to take: blocks, whole passes, words of the last pass, slots."""
    take = F.floor("target").cast("long")
    return (
        sources.where("target >= 1")
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("passes", F.floor(take / F.col("source_size")).cast("long"))
        .withColumn("rest", take - F.col("passes") * F.col("source_size"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    )


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, number, pass, block, start, end: what each slot takes of its source's stream."""
    spark = sources.sparkSession
    ordered = Window.partitionBy().orderBy("number")
    everything = Window.partitionBy()
    shares = (
        needed(sources, block)
        .withColumn("all", F.sum("slots").over(everything))
        .withColumn("high", F.sum("slots").over(ordered) / F.col("all"))
        .withColumn("low", (F.sum("slots").over(ordered) - F.col("slots")) / F.col("all"))
    )
    total = shares.agg(F.max("all")).first()[0] or 0
    # Neighbouring points are under 2 / n apart, so 3 times the slots fill each share.
    points = spark.range(3 * total + 16 if total else 0).select(
        F.col("id").alias("slot"),
        F.floor(F.col("id") / CHUNK).cast("long").alias("chunk"),
    )
    turn = F.col("chunk") * F.lit((CHUNK * GOLDEN) % 1) + (F.col("slot") % CHUNK) * F.lit(GOLDEN)
    points = points.withColumn("point", turn - F.floor(turn)).withColumn(
        "cell", F.floor(F.col("point") * CELLS).cast("int")
    )
    by_cell = shares.withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor(F.col("low") * CELLS).cast("int"),
                F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("int"),
            )
        ),
    )
    hit = points.join(by_cell, "cell").where("low <= point and point < high")
    in_chunk = Window.partitionBy("number", "chunk").orderBy("slot")
    chunks = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hit.groupBy("number", "chunk")
        .count()
        .select("number", "chunk", F.coalesce(F.sum("count").over(chunks), F.lit(0)).alias("earlier"))
    )
    ranked = hit.withColumn("place", F.row_number().over(in_chunk) - 1).join(starts, ["number", "chunk"])
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("place")).where("rank < slots")
    start = F.col("block") * block
    last = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    return (
        ranked.withColumn("pass", F.floor(F.col("rank") / F.col("blocks")).cast("long"))
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .select("slot", "number", "pass", "block", start.alias("start"), F.least(start + block, last).alias("end"))
    )


def _running(column: str, window: Column) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK,
) -> DataFrame:
    """key, size, source_size, target, taken: how many words the mix takes of each document."""
    rows = taken(documents, key, text, source, weights, share, most, block)
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def taken(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK,
) -> DataFrame:
    """As ``mix``, with place and source as well: key, place, source, size, source_size, target, taken."""
    sizes = sized(documents, key, text, source)
    sources = targets(sizes, weights, share, most)
    path = scratch_path(documents.sparkSession, "targets")
    sources.coalesce(1).write.parquet(path)
    sources = documents.sparkSession.read.schema(sources.schema).parquet(path)
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select(
        "key", "size", "place", "number", sources["source"], "source_size", "target", F.substring("place", 1, DIGITS).alias("bucket")
    )
    buckets = (
        rows.groupBy("number", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("earlier", _running("words", Window.partitionBy("number").orderBy("bucket")))
    )
    inside = Window.partitionBy("number", "bucket").orderBy("place", "size")
    placed = (
        rows.withColumn("inside", _running("size", inside))
        .join(buckets.drop("words"), ["number", "bucket"])
        .withColumn("from", F.col("earlier") + F.col("inside"))
        .withColumn("to", F.col("from") + F.col("size"))
    )
    first, final = F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)
    parts = placed.withColumn(
        "block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first.cast("long"), final.cast("long"))))
    )
    overlap = F.when(
        F.col("start").isNotNull(),
        F.greatest(F.lit(0), F.least("to", "end") - F.greatest("from", "start")),
    ).otherwise(0)
    scheduled = parts.join(schedule(sources, block).drop("slot", "pass"), ["number", "block"], "left")
    return (
        scheduled.groupBy("number", "source", "from", "key", "size", "source_size", "target", "place", "inside")
        .agg(F.sum(overlap).alias("taken"), F.count(F.lit(1)).alias("parts"))
        .withColumn("copies", F.when(F.col("size") == 0, F.col("parts")).otherwise(F.lit(1)))
        .withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("key", "place", "source", "size", "source_size", "target", "taken")
    )


def mixed(
    documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The rows as often as the mix takes them: the nearest number of whole times, halves up.

    Rows of one source, equal in size and in key, or in text where the key is null, take equal
    parts of what the mix takes of them; rows without a word are never taken.
    """
    rows = taken(documents, key, text, source, **options)
    times = rows.groupBy("place", "size", "source").agg(
        F.try_divide(F.sum("taken"), F.col("size") * F.count(F.lit(1))).alias("share")
    )
    times = times.withColumn("times", F.floor(F.col("share") + 0.5).cast("int")).where("times > 0")
    placed = documents.select(
        F.struct("*").alias("row"),
        place(key, text).alias("place"),
        words(text).alias("size"),
        F.col(source).cast("string").alias("source"),
    )
    same = [placed[name].eqNullSafe(times[name]) for name in ("place", "size", "source")]
    again = placed.join(times, same).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return again.select("row.*")
