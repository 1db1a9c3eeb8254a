"""Every query with an oracle gives DuckDB's rows, names and types."""

from __future__ import annotations

import re

import pytest
from check_oracles import differences, oracle
from conftest import SMALL, plan_of

from __spark_entry__ import entry, oracle_sql, queries


def own(queries: dict) -> dict:
    """Without the queries of the subpackage that can be left out."""
    return {k: v for k, v in queries.items() if not re.match(r"op\d+_|pipeline$", k)}


SQL = own(oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_oracle(spark, duck, name):
    assert differences(queries()[name](spark, SMALL), duck, SQL[name]) is None


def test_every_oracle_has_its_query():
    assert set(SQL) < set(own(queries()))
    assert {name for name in own(queries()) if name not in SQL} == {
        "als_predict_pairs",
        "als_user_recs",
        "als_item_similarity",
        "als_grid_search",
    }


def test_statistics_scan_the_ratings_once(spark):
    for name, scans in (("statistics_one_pass", 1), ("rmse_baseline", 1), ("grid_points", 1), ("rmse_pairs", 2)):
        assert plan_of(queries()[name](spark, SMALL)).count("FileScan") <= scans


def test_loaders_read_text_files(spark):
    for name in ("load_movies", "load_ratings", "load_tags"):
        assert "FileScan text" in plan_of(queries()[name](spark, SMALL))


def test_lookups_reach_the_scan(spark):
    assert "In(mid, [7,77,777])" in plan_of(queries()["clustered_lookup"](spark, SMALL))


def test_entry(spark):
    assert entry(spark).columns == ["genre", "rk", "mid", "avg"]
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["load_ratings", "load_tags", "rating_count_by_month", "split_test"])
def test_session_time_zone_plays_no_part(spark, duck, name):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert differences(queries()[name](spark, SMALL), duck, SQL[name]) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_pairwise_joins(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
