"""Popularity kept up to date by a stream of ratings.

Ratings arrive as files in a folder. A run takes what has arrived since the last one, adds it to
the state, one row for each movie and open day, and appends the days that are closed to a
table; month and overall statistics are sums over that table, so neither ratings nor closed
days are read again. A day is closed when a rating ``delay`` later than its end has been seen by a run
that is over; ratings that arrive for a closed day are dropped. What counts as seen does not
depend on the order of rows or files within a run.

Counts are summed in each task before the shuffle, so a movie with a third of all ratings costs a
row per task and day. The checkpoint holds the state and what was read; a run that is stopped anywhere is
finished by the next, and the table's own log keeps a batch from being added twice. State is kept in
as many partitions as ``spark.sql.shuffle.partitions`` says at the first run. For many
millions of open movie days name RocksDB in ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.calendar import SECONDS_PER_DAY, year_month
from marquee.schemas import RATING

DELAY = "30 days"

#: A movie's ratings of one day (days since 1970 in UTC).
DAILY = T.StructType(
    [
        T.StructField("day", T.IntegerType()),
        T.StructField("mid", T.IntegerType()),
        T.StructField("count", T.LongType()),
        T.StructField("scored", T.LongType()),
        T.StructField("total", T.DoubleType()),
    ]
)


def rating_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The ratings in the files of a folder, as they arrive; ``options`` go to Spark's reader."""
    return spark.readStream.format(fmt).schema(RATING).options(**options).load(path)


def daily_totals(ratings: DataFrame, delay: str = DELAY) -> DataFrame:
    """``DAILY`` rows of a stream (or table) of ratings, days closed ``delay`` after their end.

    Ratings without a time belong to no day and are left out.
    """
    timed = ratings.where("timestamp IS NOT NULL").withColumn("at", F.timestamp_seconds("timestamp"))
    days = (
        timed.withWatermark("at", delay)
        .groupBy(F.window("at", f"{SECONDS_PER_DAY} seconds").alias("window"), "mid")
        .agg(F.count("mid").alias("count"), F.count("score").alias("scored"), F.sum("score").alias("total"))
    )
    day = F.floor(F.unix_seconds("window.start") / SECONDS_PER_DAY).cast("int")
    return days.select(day.alias("day"), "mid", "count", "scored", "total")


def run(ratings: DataFrame, target: str, checkpoint: str, delay: str = DELAY) -> dict[str, int]:
    """Add all that has arrived, append the closed days to ``target`` and stop.

    Returns the rows read, and the rows of movie days that came too late.
    """
    stream = (
        daily_totals(ratings, delay)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    late = sum(state.numRowsDroppedByWatermark for batch in stream.recentProgress for state in batch.stateOperators)
    return {"read": sum(batch.numInputRows for batch in stream.recentProgress), "late": late}


def closed_days(spark: SparkSession, target: str) -> DataFrame:
    """The ``DAILY`` rows appended so far."""
    return spark.read.schema(DAILY).parquet(target)


def monthly_totals(days: DataFrame) -> DataFrame:
    """``popularity.monthly_totals`` from days: ``(yearmonth, mid, count, scored, total)``."""
    month = year_month(F.col("day").cast("long") * SECONDS_PER_DAY)
    return days.groupBy(month.alias("yearmonth"), "mid").agg(
        *(F.sum(name).alias(name) for name in ("count", "scored", "total"))
    )
