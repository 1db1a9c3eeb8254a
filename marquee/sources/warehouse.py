"""Movies, ratings and tags as projections of the given order tables.

No filters: every row of the source table becomes one row. ``ratings`` needs no join, so a
query's plan shows that query's own work; ``customer_ratings`` has more users. Times are
taken apart as wall-clock values, so the session's time zone plays no part.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.calendar import SECONDS_PER_DAY
from marquee.operators.means import weighted_means

# Stand-in vocabulary: names that contain a genre's name (Musical, TV Movie), one that is
# nearly one (Sci-Fi), some that are one in full, and names of other things.
VOCABULARY = (
    "Musical",
    "Western",
    "Sci-Fi",
    "Heist",
    "TV Movie",
    "Courtroom Drama",
    "Noir",
    "Family",
    "War",
    "Road Movie",
    "Comedy",
    "Science Fiction",
    "Anthology",
    "Historical",
    "Crime Thriller",
    "Silent",
    "Animation",
    "Sports",
    "Foreign",
    "Action",
    "Ghost Story",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _epoch(wall_clock: Column) -> Column:
    day = F.unix_date(wall_clock.cast("date")).cast("long") * SECONDS_PER_DAY
    time = F.hour(wall_clock) * 3600 + F.minute(wall_clock) * 60 + F.second(wall_clock)
    return (day + time).cast("int")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per line item: supplier rates part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("uid"),
        F.col("l_partkey").cast("int").alias("mid"),
        (F.col("l_quantity") / 10).alias("score"),
        _epoch(F.col("l_shipdate")).alias("timestamp"),
    )


def customer_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per line item: the customer of its order rates the part."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("int").alias("uid"),
        F.col("l_partkey").cast("int").alias("mid"),
        (F.col("l_quantity") / 10).alias("score"),
        _epoch(F.col("l_shipdate")).alias("timestamp"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One movie per part, with two genres."""
    names = F.array(*[F.lit(name) for name in VOCABULARY])
    key = F.col("p_partkey")
    first = F.get(names, F.pmod(key, F.lit(len(VOCABULARY))).cast("int"))
    second = F.get(names, F.pmod(F.floor(key / 7), F.lit(len(VOCABULARY))).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.cast("int").alias("mid"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_type", "p_name").alias("descri"),
        F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("minutes")).alias("timelong"),
        F.lit("").alias("issue"),
        F.lit("").alias("shoot"),
        F.col("p_type").alias("language"),
        F.concat_ws("|", first, second).alias("genres"),
        F.col("p_name").alias("actors"),
        F.col("p_brand").alias("directors"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tag per event: the event's ``k`` is the movie, type and user the tag."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("uid"),
        F.get_json_object("props", "$.k").cast("int").alias("mid"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("tag"),
        _epoch(F.col("ts")).alias("timestamp"),
    )


def as_lines(df: DataFrame, sep: str) -> DataFrame:
    """Rows as the delimited text the loaders read, strings padded with blanks."""

    def field(name: str, kind: str) -> Column:
        padded = F.concat(F.lit(" "), F.col(name), F.lit("\t "))
        return padded if kind == "string" else F.col(name).cast("string")

    fields = [field(name, kind) for name, kind in df.dtypes]
    return df.select(F.concat_ws(sep, *fields).alias("value"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for learned item factors: ``(mid, features)``, one vector each."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("mid"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def movie_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(mid, features)`` of every movie, as precise as they are stored; movies share the vectors in turn."""
    stored = table(spark, sf_dir, "embeddings")
    vectors = stored.select(F.col("vec_id").cast("int").alias("turn"), F.col("embedding").alias("features"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("mid"))
    turns = parts.withColumn("turn", F.pmod("mid", stored.agg(F.count("*")).scalar()).cast("int"))
    return turns.join(vectors, "turn").select("mid", "features")


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for learned user factors: ``(uid, features)``.

    The mean of the vectors of the movies a customer rated, weighted by total score.
    """
    rated = customer_ratings(spark, sf_dir)
    totals = rated.groupBy("uid", "mid").agg(F.sum("score").alias("weight"))
    means = weighted_means(totals.withColumnsRenamed({"uid": "id", "mid": "of"}), movie_vectors(spark, sf_dir).withColumnRenamed("mid", "id"))
    return means.withColumnRenamed("id", "uid")
