"""The best rated movies of each genre."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.genre_names import GENRES
from marquee.operators.topk import nest_recommendations, top_k_per_group


def match_genres(movies: DataFrame, genres: Sequence[str] = GENRES) -> DataFrame:
    """One row ``(genre, <movie columns>)`` per genre found in the movie's ``genres``.

    A genre is found where its name occurs in the text, in any letter case:
    "Music" is found in "Musical". The list of names is a literal, so this takes
    no join: every movie is tested against it in place.
    """
    pairs = [F.struct(F.lit(g).alias("genre"), F.lit(g.lower()).alias("_name")) for g in genres]
    return (
        movies.withColumn("_text", F.lower("genres"))
        .select(F.inline(F.array(*pairs)), "*")
        .filter(F.col("_text").contains(F.col("_name")))
        .drop("_text", "_name")
    )


def movies_with_average(movies: DataFrame, averages: DataFrame) -> DataFrame:
    """``movies`` with their ``avg``; movies nobody rated drop out."""
    return movies.join(averages, "mid")


def genre_top_k(
    movies: DataFrame, averages: DataFrame, k: int = 10, genres: Sequence[str] = GENRES
) -> DataFrame:
    """``(genre, rk, mid, avg)``: the ``k`` best movies by average, ties by ``mid``."""
    scored = movies_with_average(movies.select("mid", "genres"), averages)
    matched = match_genres(scored, genres).select("genre", "mid", "avg")
    best = top_k_per_group(matched, "genre", [F.desc("avg"), F.asc("mid")], k)
    return best.select("genre", "rk", "mid", "avg")


def genre_top_k_nested(
    movies: DataFrame, averages: DataFrame, k: int = 10, genres: Sequence[str] = GENRES
) -> DataFrame:
    """``(genres, recs)``: the same as one list per genre."""
    flat = genre_top_k(movies, averages, k, genres).withColumnRenamed("genre", "genres")
    return nest_recommendations(flat, "genres", score="avg")
