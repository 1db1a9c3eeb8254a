from __future__ import annotations

import random

import pytest
from conftest import plan_of

from marquee.operators import maintained, popularity
from marquee.schemas import RATING

START = 1_000_000_000


def rows_of(seed, n=300):
    rng = random.Random(seed)
    return [(rng.randint(1, 9), rng.randint(1, 12), rng.choice([None, rng.randint(1, 50) / 10]), START + rng.randrange(9_000_000)) for _ in range(n)]


def plain(spark, rows):
    return as_dict(popularity.monthly_totals(spark.createDataFrame(rows, RATING)))


def as_dict(totals):
    return {(r.yearmonth, r.mid): (r["count"], r.scored, None if r.total is None else round(r.total, 6)) for r in totals.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_batches_equals_recomputing(spark, tmp_path, seed):
    rng, path = random.Random(seed), str(tmp_path)
    alive, batch = [], 0
    frame = lambda rows: spark.createDataFrame(rows, RATING)
    for start in range(0, 300, 100):
        batch += rng.randint(1, 3)
        new = rows_of(seed)[start : start + 100]
        gone = rng.sample(alive, len(alive) // 3)
        maintained.record(path, batch, frame(new), frame(gone) if gone else None)
        alive += new
        for row in gone:
            alive.remove(row)
        assert as_dict(maintained.totals(spark, path)) == plain(spark, alive)
        if rng.random() < 0.7:
            maintained.compact(spark, path)
            assert as_dict(maintained.totals(spark, path)) == plain(spark, alive)
    maintained.record(path, batch + 1, deleted=frame(alive))
    assert as_dict(maintained.totals(spark, path)) == {}
    maintained.compact(spark, path)
    assert as_dict(maintained.totals(spark, path)) == {}


def test_a_batch_recorded_again_counts_once(spark, tmp_path):
    path, rows = str(tmp_path), rows_of(3, 50)
    for _ in range(2):
        maintained.record(path, 1, spark.createDataFrame(rows, RATING))
    assert as_dict(maintained.totals(spark, path)) == plain(spark, rows)
    maintained.compact(spark, path)
    with pytest.raises(ValueError, match="compacted"):
        maintained.record(path, 1, spark.createDataFrame(rows, RATING))
    with pytest.raises(ValueError, match="needs"):
        maintained.record(path, 2)


def test_unfinished_tables_do_not_count(spark, tmp_path):
    path, rows = str(tmp_path), rows_of(4, 60)
    maintained.record(path, 1, spark.createDataFrame(rows, RATING))
    maintained.record(path, 2, spark.createDataFrame(rows, RATING))
    (tmp_path / "batches" / f"{2:012d}" / "_SUCCESS").unlink()
    assert as_dict(maintained.totals(spark, path)) == plain(spark, rows)
    maintained.compact(spark, path, 1, keep=True)
    (tmp_path / "bases" / f"{1:012d}" / "_SUCCESS").unlink()  # a base cut off before its end: the batch still counts
    assert as_dict(maintained.totals(spark, path)) == plain(spark, rows)


def test_earlier_states_and_wrong_deletes(spark, tmp_path):
    path, rows = str(tmp_path), rows_of(5, 80)
    maintained.record(path, 1, spark.createDataFrame(rows[:40], RATING))
    maintained.record(path, 5, spark.createDataFrame(rows[40:], RATING))
    assert as_dict(maintained.totals(spark, path, upto=4)) == plain(spark, rows[:40])
    maintained.record(path, 6, deleted=spark.createDataFrame([(1, 99, 1.0, START)], RATING))
    with pytest.raises(Exception, match="not there"):
        maintained.totals(spark, path).collect()
    assert as_dict(maintained.totals(spark, str(tmp_path / "none"))) == {}


def test_statistics_from_maintained_totals(spark, tmp_path):
    path, rows = str(tmp_path), rows_of(6)
    maintained.record(path, 1, spark.createDataFrame(rows, RATING))
    totals = maintained.totals(spark, path)
    got = {r.mid: (r["count"], round(r.avg, 6)) for r in popularity.statistics_from_totals(totals).collect()}
    ratings = spark.createDataFrame(rows, RATING)
    counts = {r.mid: r["count"] for r in popularity.rating_count(ratings).collect()}
    averages = {r.mid: round(r.avg, 6) for r in popularity.average_score(ratings).collect()}
    assert got == {mid: (counts[mid], averages[mid]) for mid in counts}


def test_tasks_follow_the_stored_rows(spark, tmp_path):
    path, rows = str(tmp_path), rows_of(5)
    maintained.record(path, 1, spark.createDataFrame(rows[:200], RATING))
    maintained.record(path, 2, spark.createDataFrame(rows[200:], RATING))
    stored = sum(len(plain(spark, some)) for some in (rows[:200], rows[200:]))
    few = maintained.totals(spark, path, task=3)
    assert f", {-(-stored // 3)}), REPARTITION_BY_NUM" in plan_of(few)
    assert as_dict(few) == plain(spark, rows) == as_dict(maintained.totals(spark, path))
    maintained.compact(spark, path, task=3)
    assert as_dict(maintained.totals(spark, path)) == plain(spark, rows)
