from __future__ import annotations

import hashlib
import math
import random

import pytest
from conftest import plan_of

from marquee.operators import bootstrap


def draws(seed, key, replicate):
    group, place = divmod(replicate, 8)
    digest = hashlib.md5("|".join([str(seed), str(group), *key]).encode()).hexdigest()
    value = int(digest[4 * place : 4 * place + 4], 16) / 65536
    n, below = 0, math.exp(-1)
    while value >= round(below * 65536) / 65536 and n < 8:
        n += 1
        below += math.exp(-1) / math.factorial(n)
    return n


def table(spark, n=2000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, 9), 3.0 + rng.gauss(0, 1), 3.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "uid int, mid int, score double, prediction double").repartition(4)


def test_replicates_equal_drawing_by_hand(spark):
    rows, frame = table(spark, 300)
    got = {r.replicate: (r.n, r.rmse) for r in bootstrap.replicates(frame, ["uid", "mid"], 16, 5).collect()}
    assert got.keys() == set(range(16))
    for replicate in got:
        weights = [draws(5, (str(u), str(m)), replicate) for u, m, *_ in rows]
        squares = sum(w * (s - p) ** 2 for w, (_, _, s, p) in zip(weights, rows))
        assert got[replicate] == (sum(weights), pytest.approx(math.sqrt(squares / sum(weights))))


def test_draws_are_poisson():
    limits = [0, *bootstrap.thresholds(), 65536]
    for k, (a, b) in enumerate(zip(limits, limits[1:])):
        assert (b - a) / 65536 == pytest.approx(math.exp(-1) / math.factorial(k), abs=2e-5)


def test_interval_holds_the_true_error(spark):
    """Errors of variance 1: nine of ten intervals of 90 % hold it, give or take."""
    held = 0
    for seed in range(12):
        drawn = bootstrap.replicates(table(spark, 400, seed)[1], ["uid", "mid"], 80)
        low, high = bootstrap.interval(drawn).first()
        held += low <= 1 <= high
        assert 0 < high - low < 0.3
    assert held >= 8


def test_odd_rows_and_one_scan(spark):
    rows = [(1, None, 1.0, 2.0), (2, 1, None, 1.0), (3, 1, 1.0, None)]
    frame = spark.createDataFrame(rows, "uid int, mid int, score double, prediction double")
    got = bootstrap.replicates(frame, ["uid", "mid"], 8).collect()
    assert all(r.rmse == 1.0 if r.n else r.rmse is None for r in got) and len(got) == 8
    assert bootstrap.interval(bootstrap.replicates(frame.limit(0), ["uid"])).first() == (None, None)
    plan = plan_of(bootstrap.replicates(table(spark, 10)[1], ["uid"], 64))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
