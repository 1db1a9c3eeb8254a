"""How sure an error is: Poisson bootstrap of the root mean squared error in one scan.

A replicate of a sample draws each row about Poisson(1) times. Here the number is read off a digest of
the row's key, 16 bits of it for each replicate, so all replicates come out of one scan as weighted sums,
the same after a retry, in any partitioning and in other engines. Sums are combined in each task, so the shuffle
carries one row per task and group of replicates, however many rows there are. Rows with equal keys are drawn
together; name enough columns to tell rows apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replicates whose bits one digest holds.
PER_DIGEST = 8
_BITS = 16


def thresholds(most: int = 8) -> list[int]:
    """At least so many of 65536 for one draw, two draws and so on: the Poisson distribution of mean 1."""
    below, out = 0.0, []
    for k in range(most):
        below += math.exp(-1) / math.factorial(k)
        out.append(round(below * 2**_BITS))
    return [t for t in out if t < 2**_BITS]


def _digest(group: Column, key: Sequence[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), group.cast("string"), *parts))


def replicates(scored: DataFrame, key: Sequence[str], count: int = 40, seed: int = 0) -> DataFrame:
    """``(replicate, n, rmse)`` from rows (score, prediction and key); rows without either score do not count.

    ``count`` is rounded up to whole digests. A replicate that draws no row has no error.
    """
    groups = math.ceil(count / PER_DIGEST)
    error = F.col("score") - F.col("prediction")
    rows = scored.where(error.isNotNull()).select(
        (error * error).alias("square"), F.explode(F.array(*(F.struct(F.lit(g).alias("group"), _digest(F.lit(g), key, seed).alias("digest")) for g in range(groups)))).alias("drawn")
    ).select("square", "drawn.*")
    sums = []
    for i in range(PER_DIGEST):
        value = F.conv(F.substring("digest", 4 * i + 1, 4), 16, 10).cast("int")
        draws = sum(((value >= limit).cast("long") for limit in thresholds()), F.lit(0).cast("long"))
        sums += [F.sum(draws).alias(f"n{i}"), F.sum(draws * F.col("square")).alias(f"s{i}")]
    found = rows.groupBy("group").agg(*sums)
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s")) for i in range(PER_DIGEST)))
    flat = found.select("group", F.inline(each))
    return flat.select((F.col("group") * PER_DIGEST + F.col("i")).alias("replicate"), "n", F.sqrt(F.try_divide("s", "n")).alias("rmse"))


def interval(drawn: DataFrame, confidence: float = 0.9) -> DataFrame:
    """``(low, high)``: the replicates' errors at the two ends of the interval.

    Of R errors in order, those at the places that leave out ``(1 - confidence) / 2`` of them at either end.
    """
    out = (1 - confidence) / 2
    errors = F.array_sort(F.collect_list("rmse"))  # one number for each replicate
    size = F.size("errors")
    skipped = F.floor(size * F.lit(out) + 1e-9).cast("int")
    return drawn.agg(errors.alias("errors")).select(
        F.get("errors", skipped).alias("low"), F.get("errors", size - 1 - skipped).alias("high")
    )
