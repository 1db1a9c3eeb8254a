"""Score quantiles, distinct raters and heaviest raters of any movies and months, from stored summaries.

Each movie and month keeps three mergeable summaries beside its count: a KLL sketch of the scores, an HLL
sketch of the raters and a list of the raters met most often. A question about any set of movies
and months merges their summaries and reads no rating. Summaries are built and merged by Spark's own
aggregates, which combine in each task, so a movie with a third of all ratings costs one summary per task.

Bounds, for the default sizes: a quantile's rank is off by at most ``RANK_ERROR`` (of 1) in 99 of 100
cases, and exact up to some 200 scores; distinct raters by some 3 % (two standard errors), exact
when few; a rater's count by at most the ratings over ``TRACKED`` times 0.75, exact while no more
raters than that are met. Ratings without a rater count, but are nobody's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.calendar import year_month

RANK_ERROR = 0.0165
TRACKED = 1024


def build(ratings: DataFrame, zone: str = "UTC", tracked: int = TRACKED) -> DataFrame:
    """``(yearmonth, mid, count, scores, raters, heaviest)``. Ratings without movie or time are left out."""
    rows = ratings.where("mid IS NOT NULL AND timestamp IS NOT NULL")
    return rows.groupBy(year_month(F.col("timestamp"), zone).alias("yearmonth"), "mid").agg(
        F.count("mid").alias("count"),
        F.kll_sketch_agg_double("score").alias("scores"),
        F.hll_sketch_agg("uid").alias("raters"),
        F.expr(f"approx_top_k_accumulate(uid, {tracked}) FILTER (WHERE uid IS NOT NULL)").alias("heaviest"),
    )


def merged(summaries: DataFrame, by: Sequence[str] = (), tracked: int = TRACKED) -> DataFrame:
    """One summary for each value of ``by``; filter and join ``summaries`` to any movies and months first.

    No summaries give no row, also without ``by``.
    """
    # Spark's combine fails on no row at all, which an aggregate without a key would hand it.
    grouped = summaries.groupBy(*by) if by else summaries.groupBy(F.lit(0).alias("all"))
    found = grouped.agg(
        F.sum("count").alias("count"),
        F.kll_merge_agg_double("scores").alias("scores"),
        F.hll_union_agg("raters").alias("raters"),
        F.expr(f"approx_top_k_combine(heaviest, {tracked})").alias("heaviest"),
    )
    return found if by else found.drop("all")


def read(summaries: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """Summaries as numbers: ``quantiles`` of the scores, ``raters`` and the ``heaviest`` (uid, count).

    The quantiles of no score are null. A rater is listed only if the count is sure to exceed the
    summary's error, so of many raters with like counts the list is short or empty.
    """
    known = F.kll_sketch_get_n_double("scores") > 0
    values = F.array(*(F.when(known, F.kll_sketch_get_quantile_double("scores", F.lit(float(q)))) for q in quantiles))
    others = [name for name in summaries.columns if name not in ("scores", "raters", "heaviest")]
    best = F.transform(F.expr(f"approx_top_k_estimate(heaviest, {top})"), lambda r: F.struct(r["item"].alias("uid"), r["count"].alias("count")))
    return summaries.select(*others, values.alias("quantiles"), F.hll_sketch_estimate("raters").alias("raters"), best.alias("heaviest"))
