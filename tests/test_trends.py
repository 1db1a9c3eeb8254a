from __future__ import annotations

import random

import pytest
from conftest import plan_of

from marquee.operators import trends

DAY = 86400


def brute(rows, days):
    out = {}
    for _, mid, _, at in rows:
        if mid is not None and at is not None:
            frame = [s for _, m, s, t in rows if m == mid and t is not None and at - days * DAY <= t <= at]
            scores = [s for s in frame if s is not None]
            out[mid, at] = len(frame), round(sum(scores) / len(scores), 6) if scores else None
    return out


@pytest.mark.parametrize(("days", "cell"), [(30, DAY), (30, 45 * DAY), (1, 3600), (3, 7)])
def test_equals_brute_force(spark, ratings_of, days, cell):
    rng = random.Random(days * cell)
    times = [rng.randrange(0, 90 * DAY, 3 * 3600) for _ in range(40)]
    rows = [(i, rng.choice([1, 1, 2, 3]), rng.choice([None, 0.1, 2.5, 5.0]), rng.choice(times) + rng.choice([0, 0, 1, -1])) for i in range(250)]
    rows += [(1, None, 1.0, 5), (1, 2, 1.0, None), (1, 7, None, -40 * DAY), (1, 7, 3.0, -10 * DAY)]
    got = trends.trailing(ratings_of(*rows).repartition(4), days, cell).collect()
    assert len(got) == len({(m, t) for _, m, _, t in rows if m is not None and t is not None})
    assert {(r.mid, r.timestamp): (r["count"], None if r.avg is None else round(r.avg, 6)) for r in got} == brute(rows, days)


def test_each_rating_gets_its_frame(spark, ratings_of):
    rows = [(1, 1, 2.0, 0), (2, 1, 4.0, 10 * DAY), (2, 1, 4.0, 10 * DAY), (3, 1, 1.0, 40 * DAY), (4, 1, 1.0, 41 * DAY), (5, None, 1.0, 3)]
    table = trends.with_trend(ratings_of(*rows))
    assert table.columns == ["uid", "mid", "score", "timestamp", "recent", "recent_avg"]
    got = sorted((r.uid, r.recent, None if r.recent_avg is None else round(r.recent_avg, 6)) for r in table.collect())
    assert got == [(1, 1, 2.0), (2, 3, round(10 / 3, 6)), (2, 3, round(10 / 3, 6)), (3, 3, 3.0), (4, 2, 1.0), (5, None, None)]
    assert trends.with_trend(ratings_of(*rows).limit(0)).collect() == []


def test_a_hot_movie_spreads_over_its_cells(spark, ratings_of):
    """The sums of one movie are grouped by cell too, so its rows go to many partitions."""
    rows = [(i, 1, 1.0, i * 3600) for i in range(2400)]
    frame = trends.trailing(ratings_of(*rows).repartition(4))
    assert frame.count() == 2400
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(mid#" in plan and "cell#" in plan.split("hashpartitioning(mid#", 1)[1]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tasks_follow_the_ratings_not_the_session(spark, ratings_of):
    rows = [(i, i % 7, 1.0, i * DAY) for i in range(300)]
    plan = plan_of(trends.trailing(ratings_of(*rows), task=5))
    assert "hashpartitioning(mid" in plan and ", 60), REPARTITION_BY_NUM" in plan
    few, many = (trends.trailing(ratings_of(*rows), task=task).collect() for task in (5, 1000))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))
