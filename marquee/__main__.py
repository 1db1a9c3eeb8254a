"""Run a job: ``spark-submit`` this file, or ``python -m marquee <job> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from marquee.functions.genre_names import GENRES
from marquee.operators import als, evaluate
from marquee.plans import jobs
from marquee.sources.text import FAILFAST, MODES


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marquee")
    commands = parser.add_subparsers(dest="job", required=True)
    load = commands.add_parser("load", help="text files to tables")
    for name in ("movies", "ratings", "tags"):
        load.add_argument(name, help=f"path of the {name} file")
    load.add_argument("--mode", choices=MODES, default=FAILFAST, help="what to do with bad lines")
    statistics = commands.add_parser("statistics", help="counts, averages, genre lists")
    statistics.add_argument("--zone", default="UTC", help="time zone of the months")
    statistics.add_argument("--genres", nargs="+", default=GENRES, help="genres with a top list")
    recommend = commands.add_parser("recommend", help="lists per user and similar movies")
    for name, default, text in (
        ("rank", als.RANK, "factors"),
        ("per-user", als.PER_USER, "movies in a user's list"),
        ("per-movie", 20, "movies in a movie's list"),
    ):
        recommend.add_argument(f"--{name}", type=int, default=default, help=text)
    recommend.add_argument("--reg", type=float, default=als.REG, help="regularisation")
    tune = commands.add_parser("tune", help="search the ALS parameters")
    tune.add_argument("--ranks", type=int, nargs="+", default=evaluate.RANKS)
    tune.add_argument("--regs", type=float, nargs="+", default=evaluate.REGS)
    tune.add_argument("--fraction", type=float, default=0.8, help="share of ratings to learn from")
    tune.add_argument("--parallelism", type=int, default=1, help="fits side by side")
    for command in (recommend, tune):
        command.add_argument("--iterations", type=int, default=als.ITERATIONS)
        command.add_argument("--seed", type=int, default=0)
    for command in (load, statistics, recommend, tune):
        command.add_argument("--target", required=True, help="folder of the tables")
        command.add_argument("--format", default="parquet", help="format of the tables")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName(f"marquee-{options.job}").getOrCreate()
    target, fmt = options.target, options.format
    if options.job == "load":
        jobs.load(
            spark, options.movies, options.ratings, options.tags, target, options.mode, fmt
        )
    elif options.job == "statistics":
        jobs.statistics(spark, target, options.genres, options.zone, fmt)
    elif options.job == "recommend":
        jobs.recommend(
            spark,
            target,
            options.rank,
            options.iterations,
            options.reg,
            options.per_user,
            options.per_movie,
            options.seed,
            fmt,
        )
    else:
        jobs.tune(
            spark,
            target,
            options.ranks,
            options.regs,
            options.iterations,
            options.fraction,
            options.seed,
            options.parallelism,
            fmt,
        ).show()


if __name__ == "__main__":
    main()
