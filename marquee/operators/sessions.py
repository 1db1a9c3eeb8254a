"""Sessions: runs of a user's events with no pause longer than a gap.

Three steps, each on less than the one before:

1. Events in one cell of the gap's length are less than a gap apart. First, last and number
   of a cell's events are sums that Spark combines before the shuffle, so a user with a
   third of all events costs a row per task and cell.
2. Inside a range of time, cells are chained where the pause between them is short enough. A user's
   ranges are apart, so they spread over tasks.
3. Only the first and the last session of a range can go on beyond it. These, at most two for each
   range, are chained once more per user; all others are done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 30 * 60
RANGE = 24 * 60 * 60
_MICROS = 1_000_000


def _micros(df: DataFrame, at: str) -> Column:
    """Microseconds since a fixed moment, whatever the session's time zone, of a column with or without one."""
    start = F.lit("1970-01-01 00:00:00").cast(df.schema[at].dataType)
    return F.timestamp_diff("MICROSECOND", start, F.col(at))


def _chained(rows: DataFrame, gap: int, *keys: str) -> DataFrame:
    """Rows (first, last, events) of equal keys joined where the pause is at most ``gap``."""
    order = Window.partitionBy(*keys).orderBy("first")
    fresh = F.coalesce((F.col("first") - F.lag("last").over(order) > gap).cast("int"), F.lit(1))
    numbered = rows.withColumn("fresh", fresh).withColumn("number", F.sum("fresh").over(order))
    return numbered.groupBy(*keys, "number").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events")
    )


def sessions(events: DataFrame, gap: int = GAP, user: str = "user_id", at: str = "ts", span: int = RANGE) -> DataFrame:
    """``(user, first, last, events)``: first and last in microseconds since 1970, wall-clock for a column without zone.

    ``gap`` and ``span`` (the length of a range) are in seconds; a pause of just the gap goes on.
    Events without a time are left out, those without a user are one user's.
    """
    pause = gap * _MICROS
    timed = events.where(F.col(at).isNotNull()).select(F.struct(F.col(user).alias("id")).alias("who"), _micros(events, at).alias("time"))
    cells = timed.groupBy("who", F.floor(F.col("time") / pause).alias("cell")).agg(
        F.min("time").alias("first"), F.max("time").alias("last"), F.count(F.lit(1)).alias("events")
    )
    # The range of a cell, not of its first event: a cell is never cut.
    ranged = cells.withColumn("range", F.floor(F.col("cell") / max(1, span // gap)))
    inside = _chained(ranged, pause, "who", "range")
    order = Window.partitionBy("who", "range")
    placed = inside.withColumn("edge", (F.col("number") == 1) | (F.col("number") == F.max("number").over(order)))
    done = placed.where("NOT edge").select("who", "first", "last", "events")
    merged = _chained(placed.where("edge").select("who", "first", "last", "events"), pause, "who")
    rows = done.unionByName(merged.select("who", "first", "last", "events"))
    return rows.select(F.col("who.id").alias(user), "first", "last", "events")
