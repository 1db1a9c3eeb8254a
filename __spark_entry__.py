"""

``queries()`` runs every operator over the whole of the given tables, or over the
movies, ratings and tags that ``marquee.sources.warehouse`` projects from them.
``oracle_sql()`` says the same in DuckDB's SQL, written from the definition of the
result. Averages are rounded to six places on both sides before they are ranked, scores
of vectors after.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marquee.functions.calendar import register_change_date, year_month  # noqa: E402
from marquee.functions.genre_names import GENRES_AS_SHIPPED  # noqa: E402
from marquee.operators import als, bootstrap, corating, diverse, evaluate, foldin, genres  # noqa: E402
from marquee.operators import maintained, nearest, pagerank, popularity, sessions, similarity  # noqa: E402
from marquee.operators import sketches, timetree, trends  # noqa: E402
from marquee.operators import tags as tagging  # noqa: E402
from marquee.schemas import MOVIE, RATING  # noqa: E402
from marquee.session import scratch_path  # noqa: E402
from marquee.sources import tables, text  # noqa: E402
from marquee.sources.warehouse import (  # noqa: E402
    VOCABULARY,
    as_lines,
    customer_ratings,
    item_vectors,
    movie_vectors,
    movies,
    ratings,
    table,
    tags,
    user_vectors,
)
from marquee.streaming import popularity as streaming  # noqa: E402

# The operators for training text, and what they need, are a part that can be left out as a whole.
try:
    importlib.import_module("corpus_pipeline")
    llm = importlib.import_module("marquee.llm.queries")
except ModuleNotFoundError as missing:
    if missing.name.startswith("marquee.") and importlib.util.find_spec("marquee.llm"):
        raise  # the part is there, but broken
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"

TOP_MOVIES = 10
SHRINKAGE = (0.1, 1.0, 10.0, 100.0)
SIMILAR = 5
LOOKED_UP = (7, 77, 777)
#: Ratings arrive in a run by their year; one in LATE comes a run later.
CUTS, LATE = (1997, 1999, 2001), 16
SESSION_GAP = 6 * 3600
WALK_ROUNDS = 4
REPLICATES = 40
DIVERSE = 3

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """The ten best movies of each genre."""
    return genre_top10(spark, SMOKE_DIR)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def _averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(popularity.average_score(ratings(spark, sf_dir)), "avg")


def _as_text(recs: str) -> Column:
    """A list of recommendations as ``mid:score mid:score ...``."""
    return F.array_join(
        F.transform(
            recs,
            lambda r: F.concat_ws(
                ":", r["mid"].cast("string"), r["score"].cast("decimal(10,6)").cast("string")
            ),
        ),
        " ",
    )


# --- sources and sinks ---------------------------------------------------------


def _as_file(spark: SparkSession, df: DataFrame, sep: str) -> str:
    """The rows written as a text file."""
    path = scratch_path(spark, "lines")
    as_lines(df, sep).write.text(path)
    return path


def load_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_movies(spark, _as_file(spark, movies(spark, sf_dir), "^"))


def load_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_ratings(spark, _as_file(spark, ratings(spark, sf_dir), ","))


def load_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_tags(spark, _as_file(spark, tags(spark, sf_dir), ","))


def typed_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table with other columns, in another order, read as movies."""
    path = scratch_path(spark, "movies")
    stored = movies(spark, sf_dir)
    tables.write_table(stored.select(F.lit(0).alias("extra"), *reversed(stored.columns)), path)
    return tables.read_table(spark, path, MOVIE)


def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "averages")
    averages = _averages(spark, sf_dir)
    tables.write_table(averages, path)
    tables.write_table(averages, path)
    return tables.read_table(spark, path, averages.schema)


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ratings-by-movie")
    tables.write_clustered(ratings(spark, sf_dir), path, "mid", lookups=["uid"])
    return tables.read_table(spark, path, RATING)


def clustered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.rating_count(_clustered(spark, sf_dir))


def clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings of three movies: the scan skips what cannot hold them."""
    return _clustered(spark, sf_dir).where(F.col("mid").isin(*LOOKED_UP))


def curved_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings of three users and of three movies, from one table in the order of both."""
    path = scratch_path(spark, "ratings-by-both")
    tables.write_curved(customer_ratings(spark, sf_dir), path, ("uid", "mid"))
    stored = tables.read_table(spark, path, RATING)
    found = [stored.where(F.col(key).isin(*LOOKED_UP)).withColumn("by", F.lit(key)) for key in ("uid", "mid")]
    return found[0].unionByName(found[1])


# --- statistics ------------------------------------------------------------------


def rating_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.rating_count(ratings(spark, sf_dir))


def popular_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.popular_movies(ratings(spark, sf_dir), TOP_MOVIES)


def rating_yearmonth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.rating_yearmonth(ratings(spark, sf_dir))


def rating_yearmonth_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_change_date(spark)
    ratings(spark, sf_dir).createOrReplaceTempView("ratings")
    return spark.sql("SELECT mid, score, changeDate(timestamp) AS yearmonth FROM ratings")


def rating_count_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.rating_count_by_month(ratings(spark, sf_dir))


def popular_latest_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.popular_latest_months(ratings(spark, sf_dir))


def average_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averages(spark, sf_dir)


def statistics_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = popularity.monthly_totals(ratings(spark, sf_dir))
    return _rounded(popularity.statistics_from_totals(totals), "avg")


def _arrivals(rows: DataFrame) -> DataFrame:
    """``rows`` with ``arrival``, the run of the stream that finds them."""
    year = F.floor(year_month(F.col("timestamp")) / 100)
    mark = F.col("uid") * 31 + F.col("mid") * 17 + F.floor(F.col("timestamp") / 86400)
    run = sum(((year >= cut).cast("int") for cut in CUTS), (F.pmod(mark, F.lit(LATE)) == 0).cast("int"))
    return rows.withColumn("arrival", run)


def streaming_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days closed by a stream in five runs, each from the checkpoint of the one before."""
    landing, target, checkpoint = (scratch_path(spark, name) for name in ("landing", "days", "state"))
    arriving = _arrivals(ratings(spark, sf_dir))
    for run in range(len(CUTS) + 2):
        arriving.where(F.col("arrival") == run).drop("arrival").write.mode("append").parquet(landing)
        streaming.run(streaming.rating_stream(spark, landing), target, checkpoint)
    days = streaming.closed_days(spark, target)
    return days.select("day", "mid", "count", F.round(F.col("total") / F.col("scored"), 6).alias("avg"))


def maintained_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with ratings that come twice, compacted on the way, and deletes of what came twice."""
    path = scratch_path(spark, "maintained")
    arriving = _arrivals(ratings(spark, sf_dir))
    twice = arriving.where("uid % 8 = 3 AND arrival < 2").drop("arrival")
    maintained.record(path, 1, arriving.where("arrival < 2").drop("arrival"))
    maintained.record(path, 2, arriving.where("arrival = 2").drop("arrival").unionByName(twice))
    maintained.compact(spark, path)
    maintained.record(path, 3, arriving.where("arrival > 2").drop("arrival"), twice)
    return _rounded(popularity.statistics_from_totals(maintained.totals(spark, path)), "avg")


def rating_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rating with number and average of the movie's ratings in the 30 days up to it."""
    return _rounded(trends.with_trend(ratings(spark, sf_dir)), "recent_avg")


def score_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each year, merged from summaries by movie and month: ratings, and whether median, raters
    and the heaviest rater's count are within their bounds."""
    rows = ratings(spark, sf_dir)
    path = scratch_path(spark, "summaries")
    tables.write_table(sketches.build(rows), path)
    year = F.floor(F.col("yearmonth") / 100).cast("int").alias("year")
    found = sketches.read(sketches.merged(tables.read_table(spark, path).select("*", year), ["year"]), [0.5], 1)
    by_year = rows.select("uid", "score", F.floor(year_month(F.col("timestamp")) / 100).cast("int").alias("year"))
    exact = by_year.groupBy("year", "uid").agg(F.count("uid").alias("n")).groupBy("year").agg(F.count("uid").alias("users"), F.max("n").alias("most"))
    median = F.col("quantiles")[0]
    # Among raters that are many and alike none stands out of the error: then none is listed.
    most_found = F.coalesce(F.get("heaviest", F.lit(0))["count"], F.lit(0))
    ranked = by_year.join(found, "year").join(exact, "year").groupBy("year", "count").agg(
        F.avg((F.col("score") < median).cast("int")).alias("below"),
        F.avg((F.col("score") <= median).cast("int")).alias("upto"),
        F.first(F.abs(F.col("raters") - F.col("users")) <= 0.05 * F.col("users")).alias("raters_within"),
        F.first(F.abs(most_found - F.col("most")) <= F.col("count") / (0.75 * sketches.TRACKED)).alias("heaviest_within"),
    )
    within = (F.col("below") - sketches.RANK_ERROR <= 0.5) & (F.col("upto") + sketches.RANK_ERROR >= 0.5)
    return ranked.select("year", "count", within.alias("median_within"), "raters_within", "heaviest_within")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(table(spark, sf_dir, "events"), SESSION_GAP)


# --- genres and tags -------------------------------------------------------------


def genre_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each genre from the first day of every quarter to that of every later one, by the tree of days."""
    path = scratch_path(spark, "tree")
    days = timetree.daily_by_genre(ratings(spark, sf_dir), movies(spark, sf_dir), GENRES_AS_SHIPPED)
    tables.write_table(timetree.build(days), path)
    tree = tables.read_table(spark, path)
    quarters = ratings(spark, sf_dir).select(F.trunc(F.timestamp_seconds("timestamp"), "quarter").alias("q"))
    starts = F.array_sort(F.collect_set(F.unix_date("q")))
    pair = F.transform("days", lambda a: F.transform(F.filter("days", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("end"))))
    ranges = quarters.agg(starts.alias("days")).select(F.inline(F.flatten(pair)))
    asked = ranges.select(F.explode(F.array(*map(F.lit, GENRES_AS_SHIPPED))).alias("genre"), "first", "end")
    return _rounded(timetree.lookup(tree, asked).drop("avg"), "total")


def movies_with_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genres.movies_with_average(
        movies(spark, sf_dir).select("mid", "name", "genres"), _averages(spark, sf_dir)
    )


def genre_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genres.match_genres(movies(spark, sf_dir).select("mid", "genres"), GENRES_AS_SHIPPED)


def genre_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genres.genre_top_k(
        movies(spark, sf_dir), _averages(spark, sf_dir), 10, GENRES_AS_SHIPPED
    )


def genre_top10_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = genres.genre_top_k_nested(movies(spark, sf_dir), _averages(spark, sf_dir))
    return nested.select("genres", _as_text("recs").alias("recs"))


def tags_by_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tags_by_movie(tags(spark, sf_dir))


def movies_with_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.movies_with_tags(movies(spark, sf_dir), tags(spark, sf_dir))


# --- recommendation --------------------------------------------------------------


def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_ratings(spark, sf_dir).select("uid").distinct()


def distinct_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).select("mid").distinct()


def topk_positive_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = nearest.top_k_by_product(
        user_vectors(spark, sf_dir).withColumnRenamed("uid", "id"),
        movie_vectors(spark, sf_dir).withColumnRenamed("mid", "id"),
        als.PER_USER,
        positive=True,
    )
    return _rounded(nearest.flat(lists).withColumnRenamed("id", "uid"), "score")


def _als(spark: SparkSession, sf_dir: str) -> als.ALSModel:
    return als.keep(als.fit(customer_ratings(spark, sf_dir)))


def als_predict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = evaluate.split(customer_ratings(spark, sf_dir))
    model = als.keep(als.fit(train))
    return als.predict(model, test.select("uid", "mid", "score"))


def als_predicted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows that get a prediction: user and movie both have factors."""
    return als_predict_pairs(spark, sf_dir).where("NOT isnan(prediction)").select("uid", "mid", "score")


def als_factor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users and movies with factors."""
    model = _als(spark, sf_dir)
    rows = [
        factors.select(F.lit(kind).alias("kind"), "id", F.size("features").alias("width"))
        for kind, factors in (("movie", model.itemFactors), ("user", model.userFactors))
    ]
    return rows[0].unionByName(rows[1])


def als_user_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return als.recommend_users(_als(spark, sf_dir))


def als_list_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's list: length within bounds, order, movies once, scores as predicted."""
    model = _als(spark, sf_dir)
    rows = als.recommend_users(model).select("uid", F.posexplode("recs").alias("pos", "rec"))
    scored = als.predict(model, rows.select("uid", "pos", F.col("rec.mid").alias("mid"), "rec.score"))
    near = F.abs(F.col("score") - F.col("prediction")) <= 1e-4 * F.greatest(F.lit(1.0), F.abs("score"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "score"))), lambda r: r["score"])
    return scored.groupBy("uid").agg(
        (F.count("mid") <= als.PER_USER).alias("short"),
        (F.count_distinct("mid") == F.count("mid")).alias("once"),
        (ordered == F.reverse(F.array_sort(F.collect_list("score")))).alias("falling"),
        (F.min("score") > 0).alias("positive"),
        F.min(near).alias("as_predicted"),
    )


def item_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = item_vectors(spark, sf_dir).withColumnRenamed("mid", "id")
    rows = nearest.flat(similarity.similar_movies(vectors, SIMILAR).withColumnRenamed("mid", "id"))
    return _rounded(rows.withColumnsRenamed({"mid": "other", "id": "mid"}), "score")


def als_item_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_movies(_als(spark, sf_dir).itemFactors)


def diverse_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's 20 best movies the three that differ most for their scores."""
    items = movie_vectors(spark, sf_dir).withColumnRenamed("mid", "id")
    users = user_vectors(spark, sf_dir).withColumnRenamed("uid", "id")
    lists = nearest.top_k_by_product(users, items, als.PER_USER, positive=True).withColumnRenamed("id", "uid")
    return _rounded(diverse.diversify(lists, items, DIVERSE), "score", "gain")


def rating_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of users and movies for a walker who starts at three users, one of whom may have no rating."""
    edges = pagerank.rating_graph(customer_ratings(spark, sf_dir))
    seeds = spark.createDataFrame([(f"u{uid}", 1.0) for uid in LOOKED_UP], "node string, weight double")
    ranks = pagerank.pagerank(edges, seeds, rounds=WALK_ROUNDS, tolerance=0.0)
    return ranks.select("node", F.round("rank", 9).alias("rank"))


def als_fold_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that a fit never saw, folded in: who gets factors, and of what width."""
    rated = customer_ratings(spark, sf_dir)
    model = als.keep(als.fit(rated.where("uid % 2 = 0")))
    folded = foldin.fold_in(model.itemFactors, rated.where("uid % 2 = 1"))
    return folded.select(F.col("id").alias("uid"), F.size("features").alias("width"))


def fold_in_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users folded in against movies with two factors each."""
    movie = movie_vectors(spark, sf_dir).select(F.col("mid").alias("id"), F.slice("features", 1, 2).alias("features"))
    folded = foldin.fold_in(movie, customer_ratings(spark, sf_dir))
    rows = folded.select(F.col("id").alias("uid"), F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
    return _rounded(rows, "x", "y")


def co_rating_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movies whose raters share most with a movie's, by likelihood ratio."""
    pairs = corating.associated(customer_ratings(spark, sf_dir), both_ways=True)
    rows = corating.similar_movies(pairs.withColumn("llr", F.round("llr", 4)), SIMILAR, both_ways=True)
    return rows.withColumnRenamed("both", "shared")


# --- evaluation ------------------------------------------------------------------


def split_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.split(ratings(spark, sf_dir))[0]


def split_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.split(ratings(spark, sf_dir))[1]


def rmse_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.rmse_of_means(ratings(spark, sf_dir)), "rmse")


def rmse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = evaluate.split(ratings(spark, sf_dir))
    return _rounded(evaluate.rmse_of_pairs(test, evaluate.movie_means(train)), "rmse")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = evaluate.split(ratings(spark, sf_dir))
    return bootstrap.replicates(test.join(evaluate.movie_means(train), "mid"), ["uid", "mid", "timestamp"], REPLICATES)


def rmse_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_errors(spark, sf_dir), "rmse")


def rmse_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bootstrap.interval(_errors(spark, sf_dir)), "low", "high")


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.shrinkage_grid(ratings(spark, sf_dir), SHRINKAGE), "rmse")


def grid_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_point(grid_points(spark, sf_dir), [F.col("reg")])


_GRIDS: dict[tuple[str, str], str] = {}


def als_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole default grid: 12 fits, all on the cached train ratings. Searched once in an
    application, as the two queries of the grid ask for the same."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _GRIDS:
        train, test = evaluate.split(customer_ratings(spark, sf_dir))
        path = scratch_path(spark, "grid")
        tables.write_table(evaluate.grid_search(train, test, parallelism=4), path)
        _GRIDS[key] = path
    return spark.read.schema("rank int, reg double, rmse double").parquet(_GRIDS[key])


def als_grid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each point of that grid: whether it has an error, and none below the chosen one's."""
    grid = als_grid_search(spark, sf_dir)
    least = evaluate.best_parameters(grid).select("rmse").scalar()
    error = F.col("rmse")
    return grid.select(
        "rank", "reg", ((error > 0) & (error < float("inf"))).alias("has_error"), (error >= least).alias("no_better_than_chosen")
    )


def queries() -> dict[str, Query]:
    """Name to query, for every operator."""
    return {
        query.__name__: query
        for query in (
            load_movies,
            load_ratings,
            load_tags,
            typed_movies,
            sink_roundtrip,
            clustered_counts,
            clustered_lookup,
            curved_lookup,
            rating_count,
            popular_top_n,
            rating_yearmonth,
            rating_yearmonth_sql,
            rating_count_by_month,
            popular_latest_month,
            average_score,
            statistics_one_pass,
            streaming_popularity,
            maintained_statistics,
            rating_trend,
            user_sessions,
            score_summaries,
            movies_with_average,
            genre_match,
            genre_ranges,
            genre_top10,
            genre_top10_nested,
            tags_by_movie,
            movies_with_tags,
            distinct_users,
            distinct_movies,
            topk_positive_per_user,
            als_predict_pairs,
            als_predicted_rows,
            als_factor_ids,
            als_user_recs,
            als_list_check,
            item_similarity,
            als_item_similarity,
            diverse_top,
            rating_walk,
            als_fold_in,
            fold_in_plane,
            co_rating_top,
            split_train,
            split_test,
            rmse_baseline,
            rmse_pairs,
            rmse_replicates,
            rmse_interval,
            grid_points,
            grid_argmin,
            als_grid_search,
            als_grid_check,
        )
    } | (llm.queries() if llm else {})


# --- the same in DuckDB ------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


RATINGS = """ratings AS (
  SELECT CAST(l_suppkey AS INT) AS uid, CAST(l_partkey AS INT) AS mid, l_quantity / 10 AS score,
         CAST(floor(epoch(l_shipdate)) AS INT) AS timestamp
  FROM lineitem)"""
CUSTOMERS = """customers AS (
  SELECT CAST(o_custkey AS INT) AS uid, CAST(l_partkey AS INT) AS mid, l_quantity / 10 AS score,
         CAST(floor(epoch(l_shipdate)) AS INT) AS timestamp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
MOVIES = f"""vocabulary AS (SELECT {_list(VOCABULARY)} AS v),
movies AS (
  SELECT CAST(p_partkey AS INT) AS mid, p_name AS name, p_type || ' ' || p_name AS descri,
         p_size || ' minutes' AS timelong, '' AS issue, '' AS shoot, p_type AS language,
         v[p_partkey % {len(VOCABULARY)} + 1] || '|' || v[p_partkey // 7 % {len(VOCABULARY)} + 1]
           AS genres,
         p_name AS actors, p_brand AS directors
  FROM part, vocabulary)"""
TAGS = """tags AS (
  SELECT CAST(user_id AS INT) AS uid, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS mid,
         event_type || ' ' || user_id AS tag, CAST(floor(epoch(ts)) AS INT) AS timestamp
  FROM events)"""
MONTHS = f"""{RATINGS},
months AS (
  SELECT *, CAST(strftime(make_timestamp(CAST(timestamp AS BIGINT) * 1000000), '%Y%m') AS INT)
              AS yearmonth
  FROM ratings)"""
AVERAGES = f"""{RATINGS},
averages AS (SELECT mid, round(avg(score), 6) AS avg FROM ratings GROUP BY mid)"""
COUNTS = f"WITH {RATINGS} SELECT mid, count(mid) AS count FROM ratings GROUP BY mid"


def _xxh64(source: str, *columns: str) -> str:
    """CTEs ending in ``digested``: 64-bit xxHash, folded over int columns, seed 42.

    One step each, as every step uses the one before it twice. 128-bit numbers keep
    the products whole.
    """
    p1, p2, p3, p5 = (
        f"CAST({prime} AS UHUGEINT)"
        for prime in (
            0x9E3779B185EBCA87,
            0xC2B2AE3D27D4EB4F,
            0x165667B19E3779F9,
            0x27D4EB2F165667C5,
        )
    )
    wrap = f"% CAST({2**64} AS UHUGEINT)"
    steps = []
    for column in columns:
        word = f"CAST((CAST({column} AS BIGINT) + {2**32}) % {2**32} AS UHUGEINT)"
        steps += [
            f"xor((h + {p5} + 4) {wrap}, ({word} * {p1}) {wrap})",
            f"(h * CAST({2**23} AS UHUGEINT)) {wrap} + (h >> 41)",
            f"((h * {p2}) {wrap} + {p3}) {wrap}",
            f"(xor(h, h >> 33) * {p2}) {wrap}",
            f"(xor(h, h >> 29) * {p3}) {wrap}",
            "xor(h, h >> 32)",
        ]
    ctes = [f"x0 AS (SELECT *, CAST(42 AS UHUGEINT) AS h FROM {source})"]
    for i, step in enumerate(steps):
        ctes.append(f"x{i + 1} AS MATERIALIZED (SELECT * REPLACE ({step} AS h) FROM x{i})")
    ctes.append(f"digested AS (SELECT *, h AS digest FROM x{len(steps)})")
    return ",\n".join(ctes)




def _split(source: str) -> str:
    return f"""{_xxh64(source, "0", "uid", "mid", "timestamp")},
train AS (SELECT uid, mid, score, timestamp FROM digested WHERE digest >> 11 < {int(0.8 * 2**53)}),
test AS (SELECT uid, mid, score, timestamp FROM digested WHERE digest >> 11 >= {int(0.8 * 2**53)})"""


ARRIVALS = f"""{MONTHS},
arrivals AS (
  SELECT *, timestamp // 86400 AS day,
         {" + ".join(f"CAST(yearmonth // 100 >= {cut} AS INT)" for cut in CUTS)}
         + CAST((uid * 31 + mid * 17 + timestamp // 86400) % {LATE} = 0 AS INT) AS arrival
  FROM months),
latest AS (SELECT arrival, max(timestamp) AS latest FROM arrivals GROUP BY arrival),
marks AS (
  SELECT arrival, max(latest) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  - 30 * 86400 AS mark
  FROM latest)"""
TOPS = f"""{CUSTOMERS},
weights AS (SELECT uid, mid, sum(score) AS weight FROM customers GROUP BY uid, mid),
vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f, count(*) OVER () AS n FROM embeddings),
items AS (
  SELECT CAST(p_partkey AS INT) AS mid, f FROM part JOIN vectors ON p_partkey % n = vec_id),
parts AS (SELECT mid, unnest(f) AS x, generate_subscripts(f, 1) AS d FROM items),
sums AS (
  SELECT uid, d, sum(weight * x) / sum(weight) AS x FROM weights JOIN parts USING (mid)
  GROUP BY uid, d),
users AS (SELECT uid, list(x ORDER BY d) AS f FROM sums GROUP BY uid),
-- Movies share vectors, so a user's score is worked out once for each vector.
scored AS (
  SELECT uid, vec_id, list_inner_product(users.f, vectors.f) AS product FROM users, vectors),
ranked AS (
  SELECT uid, CAST(p_partkey AS INT) AS mid, product
  FROM scored JOIN vectors USING (vec_id) JOIN part ON p_partkey % n = vec_id WHERE product > 0),
tops AS (
  SELECT uid, mid, product,
         CAST(row_number() OVER (PARTITION BY uid ORDER BY product DESC, mid) AS INT) AS rk
  FROM ranked QUALIFY rk <= {als.PER_USER})"""
WALK = f"""{CUSTOMERS},
links AS (SELECT 'u' || uid AS a, 'm' || mid AS b, sum(score) AS w FROM customers GROUP BY ALL),
shares AS (
  SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share
  FROM (SELECT a AS src, b AS dst, w FROM links UNION ALL SELECT b, a, w FROM links)),
starts AS (SELECT 'u' || unnest({list(LOOKED_UP)}) AS node, 1 / {len(LOOKED_UP)} AS start),
ranks0 AS (SELECT node, start AS rank FROM starts)""" + "".join(
    f""",
got{i} AS MATERIALIZED (
  SELECT dst AS node, sum(rank * share) AS got FROM ranks{i - 1} JOIN shares ON node = src GROUP BY dst),
ranks{i} AS MATERIALIZED (
  SELECT node, (0.15 + 0.85 * (1 - (SELECT sum(got) FROM got{i}))) * coalesce(start, 0) + 0.85 * coalesce(got, 0) AS rank
  FROM got{i} FULL JOIN starts USING (node))"""
    for i in range(1, WALK_ROUNDS + 1)
)
SPLIT = f"{RATINGS},\n{_split('ratings')}"
MEANS = f"""{SPLIT},
means AS (SELECT mid, avg(score) AS prediction FROM train GROUP BY mid)"""
DRAWN = f"""{MEANS},
drawn AS (
  SELECT (score - prediction) ** 2 AS square, place, digit,
         md5('0|' || place || '|' || uid || '|' || mid || '|' || timestamp) AS digest
  FROM test JOIN means USING (mid), (SELECT unnest(range({REPLICATES // 8})) AS place), (SELECT unnest(range(8)) AS digit)),
times AS (
  SELECT place * 8 + digit AS replicate, square,
         len(list_filter({bootstrap.thresholds()}, lambda t: CAST('0x' || substr(digest, 4 * digit + 1, 4) AS INT) >= t)) AS w
  FROM drawn),
replicates AS (
  SELECT CAST(replicate AS INT) AS replicate, CAST(sum(w) AS BIGINT) AS n, sqrt(sum(w * square) / sum(w)) AS rmse
  FROM times GROUP BY replicate)"""
GRID = f"""{SPLIT},
totals AS (SELECT mid, sum(score) AS s, count(*) AS n FROM train GROUP BY mid),
shrunken AS (
  SELECT reg, mid, (s + reg * (SELECT avg(score) FROM train)) / (n + reg) AS prediction
  FROM totals, (SELECT CAST(unnest([{", ".join(map(str, SHRINKAGE))}]) AS DOUBLE) AS reg)),
grid AS (
  SELECT reg, round(sqrt(avg((score - prediction) ** 2)), 6) AS rmse
  FROM test JOIN shrunken USING (mid) GROUP BY reg)"""


def _genre_top(names, k: int) -> str:
    return f"""{AVERAGES}, {MOVIES},
matched AS (
  SELECT genre, mid, avg
  FROM movies JOIN averages USING (mid), (SELECT unnest({_list(names)}) AS genre)
  WHERE contains(lower(genres), lower(genre))),
best AS (
  SELECT genre, CAST(row_number() OVER (PARTITION BY genre ORDER BY avg DESC, mid) AS INT) AS rk,
         mid, avg
  FROM matched QUALIFY rk <= {k})"""


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL; what ALS learns has no equivalent in SQL."""
    yearmonth = f"WITH {MONTHS} SELECT mid, score, yearmonth FROM months"
    genres_default = [genre.replace("Famil y", "Family") for genre in GENRES_AS_SHIPPED]
    averages = f"WITH {AVERAGES} SELECT * FROM averages"
    return {
        "load_movies": f"WITH {MOVIES} SELECT * FROM movies",
        "load_ratings": f"WITH {RATINGS} SELECT * FROM ratings",
        "load_tags": f"WITH {TAGS} SELECT * FROM tags",
        "sink_roundtrip": averages,
        "clustered_counts": COUNTS,
        "clustered_lookup": f"WITH {RATINGS} SELECT * FROM ratings WHERE mid IN {LOOKED_UP}",
        "curved_lookup": f"""WITH {CUSTOMERS}
SELECT *, 'uid' AS by FROM customers WHERE uid IN {LOOKED_UP}
UNION ALL SELECT *, 'mid' FROM customers WHERE mid IN {LOOKED_UP}""",
        "genre_ranges": f"""WITH {RATINGS}, {MOVIES},
matched AS (
  SELECT genre, mid FROM movies, (SELECT unnest({_list(GENRES_AS_SHIPPED)}) AS genre)
  WHERE contains(lower(genres), lower(genre))),
days AS (
  SELECT genre, timestamp // 86400 AS day, count(*) AS n, sum(score) AS total
  FROM ratings JOIN matched USING (mid) GROUP BY ALL),
quarters AS (
  SELECT DISTINCT CAST(epoch(date_trunc('quarter', make_timestamp(CAST(timestamp AS BIGINT) * 1000000))) // 86400 AS INT) AS q
  FROM ratings)
SELECT genre, a.q AS first, b.q AS "end", CAST(sum(n) AS BIGINT) AS count, round(sum(total), 6) AS total
FROM quarters a JOIN quarters b ON a.q < b.q JOIN days ON day >= a.q AND day < b.q GROUP BY genre, a.q, b.q""",
        "typed_movies": f"WITH {MOVIES} SELECT * FROM movies",
        "rating_count": COUNTS,
        "popular_top_n": f"{COUNTS} ORDER BY count DESC, mid LIMIT {TOP_MOVIES}",
        "rating_yearmonth": yearmonth,
        "rating_yearmonth_sql": yearmonth,
        "rating_count_by_month": f"""WITH {MONTHS}
SELECT mid, count(mid) AS count, yearmonth FROM months GROUP BY yearmonth, mid
ORDER BY yearmonth DESC, count DESC, mid""",
        "popular_latest_month": f"""WITH {MONTHS}
SELECT mid, count(mid) AS count, yearmonth FROM months
WHERE yearmonth = (SELECT max(yearmonth) FROM months) GROUP BY yearmonth, mid
ORDER BY yearmonth DESC, count DESC, mid""",
        "average_score": averages,
        "statistics_one_pass": f"""WITH {RATINGS}
SELECT mid, count(mid) AS count, round(avg(score), 6) AS avg FROM ratings GROUP BY mid""",
        "streaming_popularity": f"""WITH {ARRIVALS}
SELECT CAST(day AS INT) AS day, mid, count(*) AS count, round(avg(score), 6) AS avg
FROM arrivals JOIN marks USING (arrival)
WHERE (mark IS NULL OR (day + 1) * 86400 > mark)
  AND (day + 1) * 86400 <= (SELECT max(timestamp) - 30 * 86400 FROM arrivals)
GROUP BY day, mid""",
        "maintained_statistics": f"""WITH {RATINGS}
SELECT mid, count(mid) AS count, round(avg(score), 6) AS avg FROM ratings GROUP BY mid""",
        "rating_trend": f"""WITH {RATINGS}
SELECT *, count(*) OVER frame AS recent, round(avg(score) OVER frame, 6) AS recent_avg FROM ratings
WINDOW frame AS (PARTITION BY mid ORDER BY timestamp RANGE BETWEEN {30 * 86400} PRECEDING AND CURRENT ROW)""",
        "score_summaries": f"""WITH {MONTHS}
SELECT yearmonth // 100 AS year, count(*) AS count, true AS median_within, true AS raters_within, true AS heaviest_within
FROM months GROUP BY year""",
        "user_sessions": f"""WITH timed AS (SELECT user_id, epoch_us(ts) AS moment FROM events),
begun AS (
  SELECT *, coalesce(moment - lag(moment) OVER (PARTITION BY user_id ORDER BY moment) > {SESSION_GAP}000000, true) AS fresh
  FROM timed),
numbered AS (
  SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY moment ROWS UNBOUNDED PRECEDING) AS number
  FROM begun)
SELECT user_id, min(moment) AS first, max(moment) AS last, count(*) AS events FROM numbered GROUP BY user_id, number""",
        "movies_with_average": f"""WITH {AVERAGES}, {MOVIES}
SELECT mid, name, genres, avg FROM movies JOIN averages USING (mid)""",
        "genre_match": f"""WITH {MOVIES}
SELECT genre, mid, genres FROM movies, (SELECT unnest({_list(GENRES_AS_SHIPPED)}) AS genre)
WHERE contains(lower(genres), lower(genre))""",
        "genre_top10": f"WITH {_genre_top(GENRES_AS_SHIPPED, 10)} SELECT * FROM best",
        "genre_top10_nested": f"""WITH {_genre_top(genres_default, 10)}
SELECT genre AS genres,
       string_agg(mid || ':' || CAST(avg AS DECIMAL(10, 6)), ' ' ORDER BY rk) AS recs
FROM best GROUP BY genre""",
        "tags_by_movie": f"""WITH {TAGS}
SELECT mid, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM tags GROUP BY mid""",
        "movies_with_tags": f"""WITH {MOVIES}, {TAGS}, joined AS (
  SELECT mid, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM tags GROUP BY mid)
SELECT * FROM movies LEFT JOIN joined USING (mid)""",
        "distinct_users": f"WITH {CUSTOMERS} SELECT DISTINCT uid FROM customers",
        "distinct_movies": f"WITH {RATINGS} SELECT DISTINCT mid FROM ratings",
        "topk_positive_per_user": f"""WITH {TOPS}
SELECT uid, mid, round(product, 6) AS score, rk FROM tops""",
        "diverse_top": f"""WITH {TOPS},
gained AS (SELECT uid, mid, product, 0.7 * product AS worth, f FROM tops JOIN items USING (mid)),
first AS (SELECT *, round(worth, 9) AS gain FROM gained
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY round(worth, 9) DESC, mid) = 1),
seconds AS (
  SELECT g.*, g.worth, list_cosine_similarity(g.f, first.f) AS near
  FROM gained g JOIN first USING (uid) WHERE g.mid <> first.mid),
second AS (SELECT *, round(worth - 0.3 * near, 9) AS gain FROM seconds
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY round(worth - 0.3 * near, 9) DESC, mid) = 1),
thirds AS (
  SELECT s.*, greatest(s.near, list_cosine_similarity(s.f, second.f)) AS nearer
  FROM seconds s JOIN second USING (uid) WHERE s.mid <> second.mid),
third AS (SELECT *, round(worth - 0.3 * nearer, 9) AS gain FROM thirds
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY round(worth - 0.3 * nearer, 9) DESC, mid) = 1)
SELECT uid, 1 AS rk, mid, round(product, 6) AS score, round(gain, 6) AS gain FROM first
UNION ALL SELECT uid, 2, mid, round(product, 6), round(gain, 6) FROM second
UNION ALL SELECT uid, 3, mid, round(product, 6), round(gain, 6) FROM third""",
        "rating_walk": f"""WITH {WALK} SELECT node, round(rank, 9) AS rank FROM ranks{WALK_ROUNDS}""",
        "als_predicted_rows": f"""WITH {CUSTOMERS}, {_split("customers")}
SELECT uid, mid, score FROM test
WHERE uid IN (SELECT uid FROM train) AND mid IN (SELECT mid FROM train)""",
        "als_factor_ids": f"""WITH {CUSTOMERS}
SELECT DISTINCT 'user' AS kind, uid AS id, {als.RANK} AS width FROM customers
UNION ALL SELECT DISTINCT 'movie', mid, {als.RANK} FROM customers""",
        "als_list_check": f"""WITH {CUSTOMERS}
SELECT DISTINCT uid, true AS short, true AS once, true AS falling, true AS positive,
       true AS as_predicted
FROM customers""",
        "item_similarity": f"""WITH items AS (
  SELECT CAST(vec_id AS INT) AS mid, CAST(embedding AS DOUBLE[]) AS f FROM embeddings),
scored AS (
  SELECT a.mid, b.mid AS other, list_cosine_similarity(a.f, b.f) AS score
  FROM items a JOIN items b ON a.mid <> b.mid)
SELECT mid, other, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY mid ORDER BY scored.score DESC, other) AS INT) AS rk
FROM scored QUALIFY rk <= {SIMILAR}""",
        "als_fold_in": f"""WITH {CUSTOMERS}
SELECT DISTINCT uid, {als.RANK} AS width FROM customers
WHERE uid % 2 = 1 AND mid IN (SELECT mid FROM customers WHERE uid % 2 = 0)""",
        "fold_in_plane": f"""WITH {CUSTOMERS},
vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f, count(*) OVER () AS n FROM embeddings),
items AS (
  SELECT CAST(p_partkey AS INT) AS mid, f[1] AS u, f[2] AS v FROM part JOIN vectors ON p_partkey % n = vec_id),
-- Two equations for each user, with the penalty on the diagonal.
sums AS (
  SELECT uid, sum(u * u) + {als.REG} * count(*) AS a, sum(v * v) + {als.REG} * count(*) AS b, sum(u * v) AS c,
         sum(score * u) AS p, sum(score * v) AS q
  FROM customers JOIN items USING (mid) GROUP BY uid)
SELECT uid, round((b * p - c * q) / (a * b - c * c), 6) AS x, round((a * q - c * p) / (a * b - c * c), 6) AS y
FROM sums""",
        "co_rating_top": f"""WITH {CUSTOMERS},
rated AS (SELECT DISTINCT uid, mid FROM customers),
movie AS (SELECT mid, count(*) AS n FROM rated GROUP BY mid),
pairs AS (
  SELECT a.mid AS a, b.mid AS b, count(*) AS k FROM rated a JOIN rated b ON a.uid = b.uid AND a.mid < b.mid GROUP BY ALL),
tables AS (
  SELECT a, b, k, x.n AS m, y.n AS n, (SELECT count(DISTINCT uid) FROM rated) AS t
  FROM pairs JOIN movie x ON x.mid = a JOIN movie y ON y.mid = b),
-- The observed counts of the four cells against those of independent choices.
cells AS (
  SELECT a, b, k AS shared, t, unnest([k, m - k, n - k, t - m - n + k]) AS seen,
         unnest([m * n, m * (t - n), (t - m) * n, (t - m) * (t - n)]) AS due
  FROM tables WHERE k * t > m * n),
judged AS (
  SELECT a, b, shared, round(2 * sum(CASE WHEN seen > 0 THEN seen * ln(seen * t / due) ELSE 0 END), 4) AS llr
  FROM cells GROUP BY a, b, shared),
ways AS (SELECT a AS mid, b AS other, shared, llr FROM judged UNION ALL SELECT b, a, shared, llr FROM judged)
SELECT mid, CAST(row_number() OVER (PARTITION BY mid ORDER BY llr DESC, other) AS INT) AS rk, other, shared, llr
FROM ways QUALIFY rk <= {SIMILAR}""",
        "split_train": f"WITH {SPLIT} SELECT * FROM train",
        "split_test": f"WITH {SPLIT} SELECT * FROM test",
        "rmse_baseline": f"""WITH {MEANS}
SELECT round(sqrt(avg((score - prediction) ** 2)), 6) AS rmse FROM test JOIN means USING (mid)""",
        "rmse_pairs": f"""WITH {MEANS},
predicted AS (SELECT uid, mid, prediction FROM test JOIN means USING (mid))
SELECT round(sqrt(avg((score - prediction) ** 2)), 6) AS rmse
FROM test JOIN predicted USING (uid, mid)""",
        "rmse_replicates": f"WITH {DRAWN} SELECT replicate, n, round(rmse, 6) AS rmse FROM replicates",
        "rmse_interval": f"""WITH {DRAWN}, placed AS (SELECT rmse, row_number() OVER (ORDER BY rmse) AS place FROM replicates)
SELECT round(min(rmse), 6) AS low, round(max(rmse), 6) AS high FROM placed
WHERE place > {REPLICATES // 20} AND place <= {REPLICATES - REPLICATES // 20}""",
        "grid_points": f"WITH {GRID} SELECT reg, rmse FROM grid",
        "grid_argmin": f"WITH {GRID} SELECT reg, rmse FROM grid ORDER BY rmse, reg LIMIT 1",
        "als_grid_check": f"""SELECT rank, reg, true AS has_error, true AS no_better_than_chosen
FROM (SELECT unnest({list(evaluate.RANKS)}) AS rank), (SELECT CAST(unnest({list(evaluate.REGS)}) AS DOUBLE) AS reg)""",
    } | (llm.oracle_sql() if llm else {})
