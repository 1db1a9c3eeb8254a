"""Delimited text files to typed relations.

Fields are separated by one character, there is no quoting and no header. A line
is well formed if it has at least the expected number of fields (further ones are
ignored) and its numbers parse; ids and times take digits with an optional sign
only, as an empty string or stray spaces there point at a shifted field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.strings import strip
from marquee.schemas import MOVIE, RATING, TAG

FAILFAST = "FAILFAST"
DROPMALFORMED = "DROPMALFORMED"
PERMISSIVE = "PERMISSIVE"
MODES = (FAILFAST, DROPMALFORMED, PERMISSIVE)
CORRUPT = "_corrupt_record"


def _typed(raw: Column, data_type: T.DataType) -> Column:
    """The field's value, NULL where it does not parse."""
    if isinstance(data_type, T.IntegerType):
        # The cast alone would forgive blanks at both ends.
        bare = (F.substring(raw, 1, 1) > " ") & (F.substring(raw, -1, 1) > " ")
        return F.when(bare, raw.try_cast("int"))
    if isinstance(data_type, T.DoubleType):
        return raw.try_cast("double")
    return strip(raw)


def parse_lines(
    lines: DataFrame, schema: T.StructType, sep: str, mode: str = FAILFAST
) -> DataFrame:
    """Parse a one-column text DataFrame (``value``).

    ``FAILFAST`` raises on the first malformed line, ``DROPMALFORMED`` leaves such
    lines out, ``PERMISSIVE`` keeps them, with NULL fields and the text in
    ``_corrupt_record``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    split = lines.select("value", F.split("value", f"\\{sep}", -1).alias("fields"))
    values = [
        _typed(F.get("fields", F.lit(i)), field.dataType).alias(field.name)
        for i, field in enumerate(schema)
    ]
    # Generated rows, as the optimizer would repeat the parsing inside the check.
    parsed = split.select("value", F.inline(F.array(F.struct(*values))))
    good = F.lit(True)
    for field in schema:
        good = good & F.col(field.name).isNotNull()
    if mode == DROPMALFORMED:
        return parsed.filter(good).select(*schema.names)
    if mode == PERMISSIVE:
        return parsed.select(
            *[F.when(good, F.col(name)).alias(name) for name in schema.names],
            F.when(~good, F.col("value")).alias(CORRUPT),
        )
    complaint = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))
    return parsed.filter(F.when(good, F.lit(True)).otherwise(complaint)).select(*schema.names)


def parse_movies(lines: DataFrame, mode: str = FAILFAST) -> DataFrame:
    return parse_lines(lines, MOVIE, "^", mode)


def parse_ratings(lines: DataFrame, mode: str = FAILFAST) -> DataFrame:
    return parse_lines(lines, RATING, ",", mode)


def parse_tags(lines: DataFrame, mode: str = FAILFAST) -> DataFrame:
    return parse_lines(lines, TAG, ",", mode)


def read_movies(spark: SparkSession, path: str, mode: str = FAILFAST) -> DataFrame:
    """``mid^name^descri^timelong^issue^shoot^language^genres^actors^directors``."""
    return parse_movies(spark.read.text(path), mode)


def read_ratings(spark: SparkSession, path: str, mode: str = FAILFAST) -> DataFrame:
    """``uid,mid,score,timestamp``."""
    return parse_ratings(spark.read.text(path), mode)


def read_tags(spark: SparkSession, path: str, mode: str = FAILFAST) -> DataFrame:
    """``uid,mid,tag,timestamp``."""
    return parse_tags(spark.read.text(path), mode)
