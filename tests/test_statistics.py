from __future__ import annotations

import re
from datetime import datetime, timezone

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from marquee.functions.calendar import register_change_date, year_month
from marquee.functions.genre_names import GENRES, GENRES_AS_SHIPPED
from marquee.operators import genres, popularity, tags
from marquee.schemas import RATING


def at(*when: int) -> int:
    return int(datetime(*when, tzinfo=timezone.utc).timestamp())


def values(df):
    return [tuple(row) for row in df.collect()]


# 23:30 on a month's last day is the next month further east, noon is not.
EDGE = at(2009, 12, 31, 23, 30)


@pytest.mark.parametrize(
    ("epoch", "zone", "expected"),
    [
        (EDGE, "UTC", 200912),
        (EDGE, "Asia/Shanghai", 201001),
        (at(2010, 1, 1, 3), "America/Los_Angeles", 200912),
        (at(2010, 7, 1, 6, 30), "America/Los_Angeles", 201006),
        (at(2010, 7, 1, 7), "America/Los_Angeles", 201007),
        (0, "UTC", 197001),
        (-1, "UTC", 196912),
        (-1, "Asia/Shanghai", 197001),
        (2**31 - 1, "UTC", 203801),
    ],
)
@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_year_month(spark, epoch, zone, expected, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame([(epoch,)], "t int").select(year_month(F.col("t"), zone).alias("m"))
        assert df.first().m == expected
        assert df.dtypes == [("m", "int")]
        if zone == "UTC":
            register_change_date(spark)
            assert spark.sql(f"SELECT changeDate({epoch}) AS m").first().m == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def rated(ratings_of):
    return ratings_of(
        (1, 10, 5.0, at(2020, 1, 5)),
        (2, 10, 4.0, at(2020, 1, 31)),
        (3, 10, 3.0, at(2020, 3, 1)),
        (1, 20, 2.0, at(2020, 3, 2)),
        (2, 20, 1.0, at(2020, 3, 31)),
        (1, 30, 4.0, at(2020, 2, 29)),
    )


def test_counts_and_averages(rated):
    assert sorted(values(popularity.rating_count(rated))) == [(10, 3), (20, 2), (30, 1)]
    assert sorted(values(popularity.average_score(rated))) == [(10, 4.0), (20, 1.5), (30, 4.0)]


def test_months_latest_first_then_most_rated(rated):
    assert values(popularity.rating_count_by_month(rated)) == [
        (20, 2, 202003),
        (10, 1, 202003),
        (30, 1, 202002),
        (10, 2, 202001),
    ]


def test_popular(rated):
    assert values(popularity.popular_movies(rated, 2)) == [(10, 3), (20, 2)]
    assert values(popularity.popular_latest_months(rated)) == [(20, 2, 202003), (10, 1, 202003)]
    assert values(popularity.popular_latest_months(rated, 2, 3)) == [
        (20, 2, 202003),
        (10, 1, 202003),
        (30, 1, 202002),
    ]


def test_latest_months_reach_over_the_year(ratings_of):
    df = ratings_of((1, 1, 1.0, at(2019, 12, 1)), (1, 2, 1.0, at(2020, 1, 9)), (1, 3, 1.0, at(2019, 11, 30)))
    assert values(popularity.popular_latest_months(df, 2)) == [(2, 1, 202001), (1, 1, 201912)]


def test_one_pass_gives_the_same(rated):
    totals = popularity.monthly_totals(rated)
    assert sorted(values(popularity.count_from_totals(totals))) == sorted(
        values(popularity.rating_count(rated))
    )
    assert values(popularity.count_by_month_from_totals(totals)) == values(
        popularity.rating_count_by_month(rated)
    )
    assert sorted(values(popularity.average_from_totals(totals))) == sorted(
        values(popularity.average_score(rated))
    )


def test_latest_months_filter_reaches_the_scan(spark, rated, tmp_path):
    rated.write.parquet(str(tmp_path / "r"))
    stored = spark.read.schema(RATING).parquet(str(tmp_path / "r"))
    plan = plan_of(popularity.popular_latest_months(stored))
    assert "Subquery" in plan
    assert "uid" not in plan.split("ReadSchema")[-1]


@pytest.fixture
def films(spark):
    return spark.createDataFrame(
        [
            (10, "War Stories", "War|Musical"),
            (20, "Space", "Science Fiction|war"),
            (30, "Static", "TV Movie"),
            (40, "Unseen", "War"),
            (50, "Blank", None),
            (60, "Lab", "Sci-Fi|Family"),
        ],
        "mid int, name string, genres string",
    )


def test_genres_are_found_by_substring(films):
    found = {(row.genre, row.mid) for row in genres.match_genres(films).collect()}
    assert found == {
        ("War", 10),
        ("Music", 10),
        ("Science", 20),
        ("War", 20),
        ("Tv", 30),
        ("War", 40),
        ("Family", 60),
    }


def test_list_as_shipped_differs_in_one_name(films):
    assert len(GENRES) == len(GENRES_AS_SHIPPED) == 20
    found = {row.genre for row in genres.match_genres(films, GENRES_AS_SHIPPED).collect()}
    assert "Family" not in found and "Famil y" not in found


def test_movies_without_ratings_drop_out(films, rated):
    joined = genres.movies_with_average(films, popularity.average_score(rated))
    assert sorted(values(joined.select("mid", "avg"))) == [(10, 4.0), (20, 1.5), (30, 4.0)]


def test_top_lists_break_ties_by_movie(spark):
    films = spark.createDataFrame([(m, "Drama") for m in range(1, 31)], "mid int, genres string")
    averages = spark.createDataFrame(
        [(m, 5.0 if m % 2 else 3.0) for m in range(1, 31)], "mid int, avg double"
    ).repartition(5)
    top = genres.genre_top_k(films, averages, 17)
    odd, even = list(range(1, 31, 2)), [2, 4]
    assert sorted(values(top.select("rk", "mid"))) == list(enumerate(odd + even, start=1))
    nested = genres.genre_top_k_nested(films, averages, 3)
    assert values(nested) == [("Drama", [(1, 5.0), (3, 5.0), (5, 5.0)])]
    assert nested.dtypes == [("genres", "string"), ("recs", "array<struct<mid:int,score:double>>")]


def test_top_lists_are_cut_before_the_shuffle(films, rated):
    plan = plan_of(genres.genre_top_k_nested(films, popularity.average_score(rated)))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.count("Exchange hashpartitioning(genre") == 1


@pytest.fixture
def tagged(spark):
    return spark.createDataFrame(
        [
            (1, 10, "b", 1),
            (2, 10, "B", 1),
            (3, 10, "b", 2),
            (1, 10, "a", 3),
            (1, 20, "only", 1),
        ],
        "uid int, mid int, tag string, timestamp int",
    )


def test_tags_are_distinct_by_case_and_in_order(tagged):
    assert sorted(values(tags.tags_by_movie(tagged))) == [(10, "B|a|b"), (20, "only")]


def test_movies_without_tags_stay(films, tagged):
    joined = tags.movies_with_tags(films, tagged)
    assert joined.columns == ["mid", "name", "genres", "tags"]
    assert sorted(values(joined.select("mid", "tags"))) == [
        (10, "B|a|b"),
        (20, "only"),
        (30, None),
        (40, None),
        (50, None),
        (60, None),
    ]


def test_repeated_tags_go_before_they_meet(tagged):
    plan = plan_of(tags.tags_by_movie(tagged))
    assert plan.index("collect_list") < plan.index("partial_collect_list")
    before = plan[plan.index("partial_collect_list") :]
    assert re.search(r"hashpartitioning\(mid#\d+, tag#\d+", before)


def test_latest_month_follows_the_zone(spark, ratings_of):
    # 2009-12-31 23:30 UTC, still November in UTC before that, already January in Tokyo.
    data = ratings_of((1, 1, 1.0, 1262302200), (1, 2, 1.0, 1262300000 - 40 * 86400), (1, 3, 1.0, 1262271600))
    latest = {row.mid: row.yearmonth for row in popularity.popular_latest_months(data).collect()}
    assert latest == {1: 200912, 3: 200912}
    tokyo = popularity.popular_latest_months(data, zone="Asia/Tokyo").collect()
    assert {row.mid: row.yearmonth for row in tokyo} == {1: 201001, 3: 201001}
    two = popularity.popular_latest_months(data, months=3, zone="Asia/Tokyo").collect()
    assert {row.mid for row in two} == {1, 2, 3}
