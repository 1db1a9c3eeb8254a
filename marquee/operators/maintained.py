"""Rating statistics kept up to date under inserts and deletes, without reading ratings again.

What is stored are totals per movie and month, whose sums are the statistics. A batch of
inserted and deleted ratings is reduced to its own totals, deletes negative, and stored
under the batch's number; reading adds up what is stored. From time to time ``compact`` adds the
batches up to some number into one base. Every table is written whole under a name of its own and
counts only once Spark's marker of success is there: a batch whose job failed is just recorded again,
one recorded twice replaces itself, and readers never meet half a batch or a half base.

Two jobs may record different batches at the same time. A batch must not be recorded again once
it is compacted; that raises an error. Deleting a rating that was never inserted is found when totals are read.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators import popularity
from marquee.session import remove

TOTALS = T.StructType(
    [
        T.StructField("yearmonth", T.IntegerType()),
        T.StructField("mid", T.IntegerType()),
        T.StructField("count", T.LongType()),
        T.StructField("scored", T.LongType()),
        T.StructField("total", T.DoubleType()),
    ]
)
#: Stored rows that one task adds up, more or less.
TASK = 1_000_000
_SUMS = ("count", "scored", "total")
_BATCHES, _BASES = "batches", "bases"


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the tables of a kind that are written to their end."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(os.path.join(path, kind))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    done = (s.getPath() for s in files.listStatus(folder) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return sorted(int(p.getName()) for p in done)


def _table(path: str, kind: str, number: int) -> str:
    return os.path.join(path, kind, f"{number:012d}")


def _summed(rows: DataFrame, task: int | None = None) -> DataFrame:
    """One row for each movie and month; with ``task``, of tables that hold a key once each, over tasks by their rows."""
    if task:
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / task))
        rows = rows.repartition(tasks, "yearmonth", "mid")
    return rows.groupBy("yearmonth", "mid").agg(*(F.sum(name).alias(name) for name in _SUMS))


def _write(rows: DataFrame, target: str) -> None:
    rows.select(*(F.col(f.name).cast(f.dataType) for f in TOTALS)).write.mode("overwrite").option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true"
    ).parquet(target)


def record(path: str, batch: int, inserted: DataFrame | None = None, deleted: DataFrame | None = None, zone: str = "UTC") -> None:
    """Store the change that a batch of ratings (uid, mid, score, timestamp) makes to the totals."""
    parts = []
    for rows, sign in ((inserted, 1), (deleted, -1)):
        if rows is not None:
            found = popularity.monthly_totals(rows, zone)
            parts.append(found.select("yearmonth", "mid", *((sign * F.col(name)).alias(name) for name in _SUMS)))
    if not parts:
        raise ValueError("a batch needs inserted or deleted ratings")
    spark = parts[0].sparkSession
    if any(batch <= base for base in _numbers(spark, path, _BASES)):
        raise ValueError(f"batch {batch} is compacted already")
    # The totals of one side have a row for each key already.
    change = parts[0] if len(parts) == 1 else _summed(parts[0].unionByName(parts[1]))
    _write(change, _table(path, _BATCHES, batch))


def _stored(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    bases = [n for n in _numbers(spark, path, _BASES) if upto is None or n <= upto]
    base = bases[-1] if bases else None
    later = [n for n in _numbers(spark, path, _BATCHES) if (base is None or n > base) and (upto is None or n <= upto)]
    tables = [_table(path, _BATCHES, n) for n in later] + ([_table(path, _BASES, base)] if bases else [])
    return spark.read.schema(TOTALS).parquet(*tables) if tables else spark.createDataFrame([], TOTALS)


def totals(spark: SparkSession, path: str, upto: int | None = None, task: int = TASK) -> DataFrame:
    """``(yearmonth, mid, count, scored, total)``, as of batch ``upto`` or of now, for movies with ratings left.

    ``popularity``'s functions of totals turn them into the statistics. ``upto`` has to be as late as the base.
    """
    summed = _summed(_stored(spark, path, upto), task).where("count <> 0 OR scored <> 0")
    checked = F.when(F.col("count") < 0, F.raise_error(F.lit("a rating was deleted that was not there"))).otherwise(F.col("count"))
    # What floating sums leave of scores that are all gone is no score.
    return summed.select(
        "yearmonth", "mid", checked.alias("count"), "scored", F.when(F.col("scored") != 0, F.col("total")).alias("total")
    )


def compact(spark: SparkSession, path: str, upto: int | None = None, keep: bool = False, task: int = TASK) -> None:
    """Add up the batches to number ``upto`` (all, by default) into a new base and remove what it replaces.

    With ``keep`` the replaced tables stay, for readers that began before.
    """
    batches = [n for n in _numbers(spark, path, _BATCHES) if upto is None or n <= upto]
    bases = _numbers(spark, path, _BASES)
    if not batches or (bases and batches[-1] <= bases[-1]):
        return
    summed = _summed(_stored(spark, path, batches[-1]), task).where("count <> 0 OR scored <> 0")
    _write(summed, _table(path, _BASES, batches[-1]))
    if not keep:
        for kind, numbers in ((_BATCHES, batches), (_BASES, bases)):
            for number in numbers:
                remove(spark, _table(path, kind, number))
