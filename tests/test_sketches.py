from __future__ import annotations

import random
from collections import Counter

import __spark_entry__
import pytest

from marquee.operators import sketches

MONTH = 31 * 86400


def table(spark, n=6000):
    """Movie 1 and user 3 have a third of all rows each."""
    rng = random.Random(2)
    pick = lambda hot, most: hot if rng.random() < 0.33 else rng.randint(1, most)
    rows = [(pick(3, 400), pick(1, 20), rng.randint(1, 500) / 100, rng.randrange(12 * MONTH)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "uid int, mid int, score double, timestamp int").repartition(5)


def test_merged_summaries_keep_their_bounds(spark, tmp_path):
    rows, ratings = table(spark)
    sketches.build(ratings).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    some = stored.where("mid <= 10 AND yearmonth BETWEEN 197002 AND 197009")
    chosen = [r for r in rows if r[1] <= 10 and 31 * 86400 <= r[3] < 273 * 86400]
    got = sketches.read(sketches.merged(some), [0.1, 0.5, 0.9]).first()
    scores = sorted(s for _, _, s, _ in chosen)
    assert got["count"] == len(chosen) > 1000
    for q, value in zip((0.1, 0.5, 0.9), got.quantiles):
        low, high = (sum(test(s) for s in scores) / len(scores) for test in (lambda s: s < value, lambda s: s <= value))
        assert low - 2 * sketches.RANK_ERROR <= q <= high + 2 * sketches.RANK_ERROR
    users = Counter(u for u, *_ in chosen)
    assert got.raters == pytest.approx(len(users), rel=0.05)
    assert [tuple(r) for r in got.heaviest][0] == (3, users[3])
    assert all(users[r.uid] == r["count"] for r in got.heaviest)  # fewer raters than are tracked


def test_any_grouping_and_small_ones_are_exact(spark):
    rows, ratings = table(spark, 900)
    got = {r.mid: r for r in sketches.read(sketches.merged(sketches.build(ratings), ["mid"]), [0.5]).where("mid > 1").collect()}
    for mid, r in got.items():
        scores = sorted(s for _, m, s, _ in rows if m == mid)
        low, high = (sum(test(s) for s in scores) / len(scores) for test in (lambda s: s < r.quantiles[0], lambda s: s <= r.quantiles[0]))
        assert r["count"] == len(scores) and low <= 0.5 <= high
        assert r.raters == len({u for u, m, *_ in rows if m == mid})


def test_odd_rows(spark):
    rows = [(1, 1, None, 0), (1, None, 1.0, 0), (None, 2, 3.0, 0), (1, 2, 1.0, None)]
    frame = spark.createDataFrame(rows, "uid int, mid int, score double, timestamp int")
    got = {r.mid: (r["count"], r.quantiles, r.raters) for r in sketches.read(sketches.build(frame), [0.5]).collect()}
    assert got == {1: (1, [None], 1), 2: (1, [3.0], 0)}
    assert sketches.read(sketches.build(frame.limit(0))).collect() == []


def test_many_raters_alike_leave_the_list_empty(spark, tmp_path):
    rows = spark.range(40_000).selectExpr(
        "id % 8000 AS l_suppkey", "id % 3 AS l_partkey", "cast(id % 50 AS double) AS l_quantity", "timestamp_seconds(id * 60) AS l_shipdate"
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = __spark_entry__.score_summaries(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(1970, 40_000, True, True, True)]


def test_no_summary_at_all_gives_no_row(spark, tmp_path):
    _, ratings = table(spark, 300)
    sketches.build(ratings).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert sketches.read(sketches.merged(stored.where("mid < 0"))).collect() == []
    assert sketches.read(sketches.merged(stored.where("mid < 0"), ["mid"])).collect() == []


def test_ratings_without_a_rater_are_nobodys(spark, tmp_path):
    rows = spark.range(12).selectExpr(
        "if(id < 9 AND id % 3 = 0, 7L, NULL) AS l_suppkey", "id % 2 AS l_partkey", "cast(id AS double) AS l_quantity",
        "timestamp_seconds(if(id < 9, 0, 366 * 86400)) AS l_shipdate",
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = __spark_entry__.score_summaries(spark, str(tmp_path)).orderBy("year").collect()
    assert [tuple(r) for r in found] == [(1970, 9, True, True, True), (1971, 3, True, True, True)]
    best = sketches.read(sketches.merged(sketches.build(__spark_entry__.ratings(spark, str(tmp_path)))), [0.5]).first()
    assert [tuple(r) for r in best.heaviest] == [(7, 3)] and best["count"] == 12
