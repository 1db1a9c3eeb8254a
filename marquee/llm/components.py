"""Connected components of a table of links, by joins alone.

Large-star and small-star steps (Kiveris et al., 2014) in turn: each node's larger
neighbours are linked to the least node of its neighbourhood, then its smaller ones. Links
only ever move to smaller nodes, and when a round changes nothing each component is a star
around its least node. Least neighbours are an aggregate, joined back, so that a node with
very many links is never gathered in one task. Each step's table is written to the shared
folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import remove, scratch_path


def stored(df: DataFrame, name: str, held: list[str] | None = None, **options: str) -> DataFrame:
    """The rows written to the shared folder and read from there; ``held`` is told the path."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, held: list[str]) -> None:
    """Remove tables that nothing reads any more."""
    while held:
        remove(spark, held.pop())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("least").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # Links run from the smaller node a to the larger b.
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    moved = links.join(least, "b")
    turned = moved.where("least < a").select(F.col("least").alias("a"), F.col("a").alias("b"))
    kept = least.select(F.col("least").alias("a"), "b")
    return kept.unionByName(turned).distinct()


def _state(links: DataFrame) -> tuple:
    """Equal for two tables of links with equal rows, but for a chance of about 2 to the -64."""
    digest = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(digest)).first())


def components(links: DataFrame) -> DataFrame:
    """node, component: for each node of links (a, b), the least node it can reach.

    Links of a node with itself count for nothing; null ends are left out.
    """
    links = stored(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    state = _state(links)
    while state[0]:
        links = stored(_small_star(_large_star(links)), "links")
        if state == (state := _state(links)):
            break
    stars = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
