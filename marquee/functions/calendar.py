"""Epoch seconds to calendar months."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def local_time(epoch_seconds: Column, zone: str) -> Column:
    """Wall-clock time in ``zone``, whatever the session's own zone is."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=epoch_seconds.cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def year_month(epoch_seconds: Column, zone: str = "UTC") -> Column:
    """``yyyyMM`` as an int, for example 200912."""
    if zone == "UTC":
        day = F.date_from_unix_date(F.floor(epoch_seconds / SECONDS_PER_DAY).cast("int"))
    else:
        day = local_time(epoch_seconds, zone)
    return F.year(day) * 100 + F.month(day)


def register_change_date(spark: SparkSession, name: str = "changeDate") -> None:
    """Make ``year_month`` (UTC) callable from SQL text, as a SQL function."""
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(x INT) RETURNS INT RETURN
          year(date_from_unix_date(CAST(floor(x / {SECONDS_PER_DAY}) AS INT))) * 100
          + month(date_from_unix_date(CAST(floor(x / {SECONDS_PER_DAY}) AS INT)))
        """
    )
