"""Ranked lexical search over an index stratified by length.

Documents of equal length normaliser m form a stratum. Within a stratum a term's postings are
grouped by tf, and the impact of a group (what its documents get for the term) is
worked out once. A list holds the documents of one group and one segment, a
segment being what one task indexed, so no list outgrows a task and no term gathers in one.

Search visits each item's strata by falling bound, the sum over its terms of their greatest
impact in the stratum. ``ROUNDS`` gives the share of an item's postings visited after each
round; the k-th best score so far, the threshold, then

* leaves out strata whose bound is below it;
* leaves out, as sources of candidates, a stratum's weakest terms, as many as stay below a share of
  the threshold together (``WEAK``): a document with no other term cannot reach it;
* leaves out candidates that cannot reach it with all of the weak terms.

What remains is scored in full from the candidates' own terms, in integers. Documents equal to the
threshold are scored, so ties are settled by id alone. The result is exact; the rounds only decide
how much is read.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are
lower-cased. Null texts have no term. Rows are ranked one by one: repeated rows are separate
documents and separate items, rows with equal score and id get consecutive ranks, a null
document id comes last. Without documents or terms nothing is returned. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, raw, record_batch, shipped
from marquee.llm.components import stored

TOP = 10
#: Shares of an item's postings visited by the end of each round.
ROUNDS = (1 / 64, 1 / 8, 1.0)

#: A stratum's weak terms stay below this share of the threshold together: the smaller, the more
#: postings are read, and the fewer candidates are looked at one by one. At most 1.
WEAK = 0.5

#: Bytes of terms as they are, A-Z as a-z, all others as spaces.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
#: Not a term: the row that carries a document's length.
LENGTH_ROW = ""


def terms_of(text: bytes) -> list[bytes]:
    """The terms of UTF-8 text, in order, with repeats."""
    return text.translate(_BYTES).split()


def counted(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, term, tf, n (the row's terms with repeats): a row for each distinct term, and one
    for ``LENGTH_ROW`` with tf = n if there is any term."""

    def work(batches):
        for batch in pieces(batches, text):
            bags = [Counter(terms_of(value)) for value in raw(batch, text)]
            sizes = np.array([sum(bag.values()) for bag in bags])
            for bag, n in zip(bags, sizes):
                if n:
                    bag[LENGTH_ROW.encode()] = n
            width = np.array([len(bag) for bag in bags])
            take = pa.array(np.repeat(np.arange(len(bags)), width))
            schema = pa.schema([*(batch.schema.field(name) for name in keys), ("term", pa.string()), ("tf", pa.int64()), ("n", pa.int64())])
            yield record_batch(
                schema,
                *(batch.column(batch.schema.get_field_index(name)).take(take) for name in keys),
                pa.array([term for bag in bags for term in bag], pa.binary()).cast(pa.string()),
                [tf for bag in bags for tf in bag.values()],
                np.repeat(sizes, width),
            )

    kinds = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keys)
    return rows.select(*keys, text).transform(shipped).mapInArrow(work, f"{kinds}, term string, tf long, n long")


@dataclass
class Index:
    """``bags``: row, tfs (term to tf), a row for each document. ``lists``: term, m, tf, impact
    (weight included), rows. ``bounds``: term, m, weight, bound, postings. ``names``: row, id."""

    bags: DataFrame
    lists: DataFrame
    bounds: DataFrame
    names: DataFrame


def impact(weight: Column, tf: Column, m: Column) -> Column:
    return weight * _div(F.lit(1_000_000_000).cast("long") * tf, 1000 * tf + 8 * m)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def build(documents: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows; only of ``terms`` (column term) where given.

    Lengths, frequencies and normalisers count every term of every document in either case.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    found = counted(rows, "text", ["row", "id"])
    if terms is not None:
        wanted = terms.select("term").unionByName(documents.sparkSession.range(1).select(F.lit(LENGTH_ROW).alias("term")))
        found = found.join(wanted.distinct(), "term", "left_semi")
    found = stored(found.select("row", "id", "term", "tf", "n"), "counted")
    lengths = found.where(F.col("term") == LENGTH_ROW)
    count, total = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(100 - 90) + _div(F.lit(90).cast("long") * F.col("n") * F.lit(count).cast("long"), F.lit(max(total, 1)).cast("long"))
    postings = found.where(F.col("term") != LENGTH_ROW).select("row", "term", "tf", m.cast("long").alias("m"))
    bags = postings.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs"))
    # The upper bits of a row's number are the task that read it: its segment.
    segment = F.shiftright("row", 33)
    grouped = stored(postings.groupBy("term", "m", "tf", segment.alias("segment")).agg(F.collect_list("row").alias("rows")), "grouped")
    groups = grouped.groupBy("term", "m", "tf").agg(F.sum(F.size("rows")).alias("docs"))
    df = groups.groupBy("term").agg(F.sum("docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(count) + 2) / (2 * F.col("df") + 1)))
    valued = groups.join(df.select("term", weight.cast("long").alias("weight")), "term").select(
        "term", "m", "tf", "docs", "weight", impact(F.col("weight"), F.col("tf"), F.col("m")).alias("impact")
    )
    valued = stored(valued, "impacts")
    bounds = valued.groupBy("term", "m").agg(F.max("weight").alias("weight"), F.max("impact").alias("bound"), F.sum("docs").alias("postings"))
    lists = grouped.join(valued, ["term", "m", "tf"]).select("term", "m", "tf", "impact", "rows")
    return Index(stored(bags, "bags"), stored(lists, "lists"), stored(bounds, "bounds"), lengths.select("row", "id"))


def planned(index: Index, terms: DataFrame, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """item, m, bound, round, terms: each item's strata, with term, weight and the bounds' sum of
    each of its terms from the weakest up."""
    struct = F.struct("bound", "term", "weight")
    strata = (
        terms.join(index.bounds, "term")
        .groupBy("item", "m")
        .agg(F.sum("bound").alias("bound"), F.sum("postings").alias("postings"), F.array_sort(F.collect_list(struct)).alias("terms"))
    )
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    before = F.sum("postings").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("postings")
    share = before / F.sum("postings").over(Window.partitionBy("item"))
    number = sum(((share >= limit).cast("int") for limit in rounds[:-1]), F.lit(0))
    sums = F.transform(
        "terms", lambda t, i: F.struct(t["term"].alias("term"), t["weight"].alias("weight"), F.aggregate(F.slice("terms", 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x["bound"]).alias("sum"))
    )
    return strata.withColumn("round", number).select("item", "m", "bound", "round", sums.alias("terms"))


def _scores(index: Index, strata: DataFrame) -> DataFrame:
    """item, row, score of all documents in the strata (item, m, threshold, terms) that can reach the threshold."""
    weak = F.filter("terms", lambda t: t["sum"] < WEAK * F.col("threshold"))
    strata = stored(strata.withColumn("weak", weak).withColumn("rest", F.coalesce(F.array_max("weak.sum"), F.lit(0))), "visited")
    strong = F.slice("terms", F.size("weak") + 1, F.size("terms"))
    sources = strata.select("item", "m", "threshold", "rest", F.explode(F.transform(strong, lambda t: t["term"])).alias("term"))
    met = sources.join(index.lists, ["term", "m"]).select("item", "m", "threshold", "rest", "impact", F.explode("rows").alias("row"))
    partial = met.groupBy("item", "row").agg(
        F.sum("impact").alias("score"), F.first("m").alias("m"), F.first("threshold").alias("threshold"), F.first("rest").alias("rest")
    )
    candidates = stored(partial.where("score > 0 AND score + rest >= threshold"), "candidates")
    # What the weak terms add, from the candidates' own terms.
    added = F.aggregate(
        "weak",
        F.lit(0).cast("long"),
        lambda s, t: s + F.coalesce(impact(t["weight"], F.col("tfs")[t["term"]], F.col("m")), F.lit(0)),
    )
    open_ = candidates.where("rest > 0").join(strata.select("item", "m", "weak"), ["item", "m"]).join(index.bags, "row")
    scored = open_.select("item", "row", "threshold", (F.col("score") + added).alias("score"))
    whole = candidates.where("rest = 0").select("item", "row", "threshold", "score")
    return whole.unionByName(scored).where("score >= threshold").select("item", "row", "score")


def search(index: Index, items: DataFrame, k: int = TOP, key: str = "item_id", text: str = "text", rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """key, rank, id, score: the k documents of highest score above 0 for each row of ``items``."""
    named = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("key"), F.col(text).alias("text")), "items")
    terms = stored(item_terms(named), "terms")
    plan = stored(planned(index, terms, rounds), "strata")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    best = None
    for number in range(len(rounds)):
        strata = plan.where(F.col("round") == number).withColumn("threshold", F.lit(1).cast("long"))
        if best is not None:
            least = best.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
            strata = strata.join(least, "item", "left").withColumn("threshold", F.coalesce("least", "threshold")).drop("least")
        strata = strata.where("bound >= threshold").select("item", "m", "threshold", "terms")
        found = _scores(index, strata).join(index.names, "row")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    return best.join(named.select("item", "key"), "item").select(F.col("key").alias(key), "rank", "id", "score")


def item_terms(items: DataFrame) -> DataFrame:
    """item, term: the distinct terms of each item."""
    return counted(items, "text", ["item"]).where(F.col("term") != LENGTH_ROW).select("item", "term")


def rank(documents: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, key, score: ``search`` in an index of the items' terms alone."""
    queries = items.select(F.lit(0).alias("item"), F.col(item_text).alias("text"))
    index = build(documents, item_terms(queries).select("term").distinct(), key, text)
    return search(index, items, k, item, item_text).withColumnRenamed("id", key)
