"""How often and how well movies are rated, overall and by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.calendar import local_time, year_month


def rating_yearmonth(ratings: DataFrame, zone: str = "UTC") -> DataFrame:
    """``(mid, score, yearmonth)``."""
    return ratings.select("mid", "score", year_month(F.col("timestamp"), zone).alias("yearmonth"))


def rating_count(ratings: DataFrame) -> DataFrame:
    """Ratings per movie: ``(mid, count)``."""
    return ratings.groupBy("mid").agg(F.count("mid").alias("count"))


def popular_movies(ratings: DataFrame, n: int) -> DataFrame:
    """The ``n`` movies with the most ratings."""
    return rating_count(ratings).orderBy(F.desc("count"), "mid").limit(n)


def rating_count_by_month(ratings: DataFrame, zone: str = "UTC") -> DataFrame:
    """Ratings per month and movie, latest month and highest count first."""
    return _latest_first(
        rating_yearmonth(ratings, zone)
        .groupBy("yearmonth", "mid")
        .agg(F.count("mid").alias("count"))
    )


def popular_latest_months(
    ratings: DataFrame, months: int = 1, n: int | None = None, zone: str = "UTC"
) -> DataFrame:
    """``rating_count_by_month`` for the last ``months`` calendar months of the zone.

    The months end with the one of the latest rating. They are picked by a bound on
    ``timestamp`` itself, which the scan can use to skip row groups.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    latest = local_time(F.max("timestamp"), zone)
    first_day = F.add_months(F.trunc(latest, "month"), 1 - months).cast("timestamp_ntz")
    begin = F.convert_timezone(F.lit(zone), F.lit("UTC"), first_day)
    seconds = F.timestamp_diff("SECOND", epoch, begin)
    since = ratings.agg(seconds.alias("since")).scalar()
    counts = rating_count_by_month(ratings.filter(F.col("timestamp") >= since), zone)
    return counts if n is None else counts.limit(n)


def average_score(ratings: DataFrame) -> DataFrame:
    """Mean score per movie: ``(mid, avg)``."""
    return ratings.groupBy("mid").agg(F.avg("score").alias("avg"))


def monthly_totals(ratings: DataFrame, zone: str = "UTC") -> DataFrame:
    """``(yearmonth, mid, count, scored, total)``, from which all three statistics follow.

    Lets a job that wants all of them scan the ratings once.
    """
    return (
        rating_yearmonth(ratings, zone)
        .groupBy("yearmonth", "mid")
        .agg(
            F.count("mid").alias("count"),
            F.count("score").alias("scored"),
            F.sum("score").alias("total"),
        )
    )


def count_from_totals(totals: DataFrame) -> DataFrame:
    return totals.groupBy("mid").agg(F.sum("count").alias("count"))


def statistics_from_totals(totals: DataFrame) -> DataFrame:
    """``(mid, count, avg)``: both statistics per movie from one pass over the totals."""
    return totals.groupBy("mid").agg(
        F.sum("count").alias("count"), (F.sum("total") / F.sum("scored")).alias("avg")
    )


def count_by_month_from_totals(totals: DataFrame) -> DataFrame:
    return _latest_first(totals.select("yearmonth", "mid", "count"))


def average_from_totals(totals: DataFrame) -> DataFrame:
    return totals.groupBy("mid").agg((F.sum("total") / F.sum("scored")).alias("avg"))


def _latest_first(counts: DataFrame) -> DataFrame:
    return counts.select("mid", "count", "yearmonth").orderBy(
        F.desc("yearmonth"), F.desc("count"), "mid"
    )
