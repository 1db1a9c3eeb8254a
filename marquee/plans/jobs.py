"""The batch jobs: load, statistics, recommendation, tuning.

Each reads and writes tables below one target folder, so they run in turn or on
their own schedules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import schemas
from marquee.functions.genre_names import GENRES
from marquee.operators import als, evaluate, genres, popularity, similarity, tags
from marquee.sources import tables, text
from marquee.sources.tables import read_table, table_path, write_table

MOVIES_WITH_TAGS = "MoviesWithTags"
REJECTED = "Rejected"
MONTHLY_TOTALS = "MonthlyTotals"
MODEL = "AlsModel"


def load(
    spark: SparkSession,
    movies_path: str,
    ratings_path: str,
    tags_path: str,
    target: str,
    mode: str = text.FAILFAST,
    fmt: str = "parquet",
) -> None:
    """Text files to the tables Movie, Rating, Tag and MoviesWithTags.

    Ratings and tags are laid out by movie, for lookups by movie and for a
    well-combining first step of everything that groups by movie. Lookups by user
    are helped by Bloom filters. With ``PERMISSIVE``, malformed lines go to tables
    of their own, MovieRejected and so on.
    """
    for read, path, name, schema, lookups in (
        (text.read_movies, movies_path, schemas.MOVIE_TABLE, schemas.MOVIE, ()),
        (text.read_ratings, ratings_path, schemas.RATING_TABLE, schemas.RATING, ("uid",)),
        (text.read_tags, tags_path, schemas.TAG_TABLE, schemas.TAG, ("uid",)),
    ):
        rows = read(spark, path, mode)
        if mode == text.PERMISSIVE:
            bad = F.col(text.CORRUPT).isNotNull()
            rejected = rows.filter(bad).select(F.col(text.CORRUPT).alias("line"))
            write_table(rejected, table_path(target, name + REJECTED), fmt)
            rows = rows.filter(~bad)
        stored_at = table_path(target, name)
        tables.write_clustered(rows.select(*schema.names), stored_at, "mid", lookups, fmt)
    stored = read_table(spark, table_path(target, schemas.MOVIE_TABLE), schemas.MOVIE, fmt)
    stored_tags = read_table(spark, table_path(target, schemas.TAG_TABLE), schemas.TAG, fmt)
    rolled_up = tags.movies_with_tags(stored, stored_tags)
    write_table(rolled_up, table_path(target, MOVIES_WITH_TAGS), fmt)


def statistics(
    spark: SparkSession,
    target: str,
    genre_names: Sequence[str] = GENRES,
    zone: str = "UTC",
    fmt: str = "parquet",
) -> None:
    """Rating counts, counts by month, averages and the top lists of the genres.

    The ratings are read once, into monthly totals per movie. These are written
    down before they are used four times.
    """
    totals_path = table_path(target, MONTHLY_TOTALS)
    write_table(popularity.monthly_totals(_ratings(spark, target, fmt), zone), totals_path, fmt)
    totals = read_table(spark, totals_path, fmt=fmt)
    movies = read_table(spark, table_path(target, schemas.MOVIE_TABLE), schemas.MOVIE, fmt)
    averages_path = table_path(target, schemas.AVERAGE_MOVIES)
    write_table(popularity.average_from_totals(totals), averages_path, fmt)
    averages = read_table(spark, averages_path, fmt=fmt)
    best = genres.genre_top_k_nested(movies, averages, 10, genre_names)
    for name, df in (
        (schemas.RATE_MORE_MOVIES, popularity.count_from_totals(totals)),
        (schemas.RATE_MORE_RECENTLY_MOVIES, popularity.count_by_month_from_totals(totals)),
        (schemas.GENRES_TOP_MOVIES, schemas.conform(best, schemas.GENRE_RECOMMENDATIONS)),
    ):
        write_table(df, table_path(target, name), fmt)


def recommend(
    spark: SparkSession,
    target: str,
    rank: int = als.RANK,
    iterations: int = als.ITERATIONS,
    reg: float = als.REG,
    per_user: int = als.PER_USER,
    per_movie: int = 20,
    seed: int = 0,
    fmt: str = "parquet",
) -> None:
    """Fit ALS, store the model, each user's movies and each movie's similar ones."""
    fitted = als.fit(_ratings(spark, target, fmt), rank, iterations, reg, seed)
    model = als.keep(fitted, table_path(target, MODEL))
    users = als.recommend_users(model, per_user)
    write_table(users, table_path(target, schemas.USER_RECS), fmt)
    movies = similarity.similar_movies(model.itemFactors, per_movie)
    write_table(movies, table_path(target, schemas.MOVIE_RECS), fmt)


def tune(
    spark: SparkSession,
    target: str,
    ranks: Sequence[int] = evaluate.RANKS,
    regs: Sequence[float] = evaluate.REGS,
    iterations: int = als.ITERATIONS,
    fraction: float = 0.8,
    seed: int = 0,
    parallelism: int = 1,
    fmt: str = "parquet",
) -> DataFrame:
    """The grid point ``(rank, reg, rmse)`` with the lowest error on held-out ratings."""
    train, test = evaluate.split(_ratings(spark, target, fmt), fraction, seed)
    grid = evaluate.grid_search(train, test, ranks, regs, iterations, seed, parallelism)
    return evaluate.best_parameters(grid)


def _ratings(spark: SparkSession, target: str, fmt: str) -> DataFrame:
    return read_table(spark, table_path(target, schemas.RATING_TABLE), schemas.RATING, fmt)
