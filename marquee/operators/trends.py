"""Trailing statistics: a movie's ratings in the days up to each rating.

The frame of a rating at t is [t - length, t]. What lies in it is what lies up to t, less what lies
before t - length, and each of the two is a running sum: over whole cells of time before, and
inside the cell. So no frame is ever walked through, and a movie's ratings are dealt by
cell: one with a third of all ratings spreads over the cells of its life. Ratings of one movie
and second are added up before anything is shuffled, which bounds a cell by its seconds. The ends of frames
are dealt over as many tasks as the ratings take, whatever the session's number of partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.calendar import SECONDS_PER_DAY

DAYS = 30
#: Seconds of a cell.
CELL = SECONDS_PER_DAY

#: Ratings whose frames one task works on, more or less.
TASK = 500_000

_SUMS = ("count", "scored", "total")


def trailing(ratings: DataFrame, days: int = DAYS, cell: int = CELL, task: int = TASK) -> DataFrame:
    """``(mid, timestamp, count, avg)`` of the frame that ends at each time a movie was rated.

    Ratings at the frame's ends count. Rows without a movie or a time are left out; null scores
    count, but not in the average.
    """
    points = (
        ratings.where("mid IS NOT NULL AND timestamp IS NOT NULL")
        .groupBy("mid", F.col("timestamp").cast("long").alias("time"))
        .agg(F.count("mid").alias("count"), F.count("score").alias("scored"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"))
    )
    # A point adds at its own time and asks at both ends of its frame: at the far end for what
    # came before that second, so it stands before the points there.
    here = F.struct(F.col("time").alias("at"), F.lit(1).alias("side"), *_SUMS)
    there = F.struct(
        (F.col("time") - days * SECONDS_PER_DAY).alias("at"),
        F.lit(-1).alias("side"),
        *(F.lit(0).cast(kind).alias(name) for name, kind in zip(_SUMS, ("long", "long", "double"))),
    )
    ends = points.select("mid", "time", F.inline(F.array(here, there))).withColumn("cell", F.floor(F.col("at") / cell))
    tasks = max(ratings.sparkSession.sparkContext.defaultParallelism, math.ceil(ratings.count() / task))
    ends = ends.repartition(tasks, "mid", "cell")
    earlier = Window.partitionBy("mid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = ends.groupBy("mid", "cell").agg(*(F.sum(name).alias(name) for name in _SUMS))
    cells = cells.select("mid", "cell", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in _SUMS))
    inside = Window.partitionBy("mid", "cell").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ends.select("mid", "time", "cell", "side", *(F.sum(name).over(inside).alias(name) for name in _SUMS))
    sums = running.join(cells, ["mid", "cell"]).groupBy("mid", "time").agg(
        *(F.sum(F.col("side") * (F.col(name) + F.col(f"{name}_before"))).alias(name) for name in _SUMS)
    )
    return sums.select(
        "mid",
        F.col("time").cast(ratings.schema["timestamp"].dataType).alias("timestamp"),
        "count",
        F.try_divide("total", "scored").alias("avg"),
    )


def with_trend(ratings: DataFrame, days: int = DAYS, cell: int = CELL, task: int = TASK) -> DataFrame:
    """``ratings`` (mid, score, timestamp, ...) with ``recent`` and ``recent_avg`` of the frame that ends at each."""
    trend = trailing(ratings, days, cell, task)
    frames = trend.select(F.col("mid").alias("of"), F.col("timestamp").alias("until"), "count", "avg")
    same = (F.col("mid") == F.col("of")) & (F.col("timestamp") == F.col("until"))
    joined = ratings.join(frames, same, "left")
    return joined.select(*(ratings[name] for name in ratings.columns), frames["count"].alias("recent"), frames["avg"].alias("recent_avg"))
