"""Column names and types of the input and output relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The relations' fields and types.
MOVIE = T.StructType(
    [T.StructField("mid", T.IntegerType())]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "name",
            "descri",
            "timelong",
            "issue",
            "shoot",
            "language",
            "genres",
            "actors",
            "directors",
        )
    ]
)
RATING = T.StructType(
    [
        T.StructField("uid", T.IntegerType()),
        T.StructField("mid", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("timestamp", T.IntegerType()),
    ]
)
TAG = T.StructType(
    [
        T.StructField("uid", T.IntegerType()),
        T.StructField("mid", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("timestamp", T.IntegerType()),
    ]
)

_RECOMMENDATIONS = T.ArrayType(
    T.StructType([T.StructField("mid", T.IntegerType()), T.StructField("score", T.DoubleType())])
)
USER_RECOMMENDATIONS = T.StructType(
    [T.StructField("uid", T.IntegerType()), T.StructField("recs", _RECOMMENDATIONS)]
)
MOVIE_RECOMMENDATIONS = T.StructType(
    [T.StructField("mid", T.IntegerType()), T.StructField("recs", _RECOMMENDATIONS)]
)
GENRE_RECOMMENDATIONS = T.StructType(
    [T.StructField("genres", T.StringType()), T.StructField("recs", _RECOMMENDATIONS)]
)

# Names of the stored tables.
MOVIE_TABLE = "Movie"
RATING_TABLE = "Rating"
TAG_TABLE = "Tag"
RATE_MORE_MOVIES = "RateMoreMovies"
RATE_MORE_RECENTLY_MOVIES = "RateMoreRecentlyMovies"
AVERAGE_MOVIES = "AverageMovies"
GENRES_TOP_MOVIES = "GenresTopMovies"
USER_RECS = "UserRecs"
MOVIE_RECS = "MovieRecs"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed read: bring ``df`` to ``schema`` by name.

    A missing column or one of an unrelated type fails when the plan is built, a
    number too large for its column fails when the row is read.
    """
    missing = [name for name in schema.names if name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {', '.join(df.columns)}")
    return df.to(schema)
