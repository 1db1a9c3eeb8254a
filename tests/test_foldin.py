from __future__ import annotations

import numpy as np
import pytest
from conftest import plan_of

from marquee.operators import als, foldin


def table(spark, seed=0, users=40, movies=25, hot=400):
    """Ratings with repeats; user 1 has as many as all others together."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(users + 1, 3)), rng.normal(size=(movies + 1, 3))
    pairs = [(int(rng.integers(2, users)), int(rng.integers(1, movies))) for _ in range(hot)]
    pairs += [(1, int(rng.integers(1, movies))) for _ in range(hot)]
    rows = [(u, m, float(round(a[u] @ b[m] + 3 + rng.normal() / 10, 1)), 0) for u, m in pairs]
    return spark.createDataFrame(rows, "uid int, mid int, score double, timestamp int").repartition(6)


def dense(factors, ratings, reg):
    known = {r.id: np.array(r.features, float) for r in factors.collect()}
    sums = {}
    for u, m, score in ratings:
        if m in known and u is not None and score is not None:
            sums.setdefault(u, []).append((known[m], score))
    out = {}
    for u, rows in sums.items():
        y, r = np.array([v for v, _ in rows]), np.array([s for _, s in rows])
        out[u] = np.linalg.solve(y.T @ y + reg * len(rows) * np.eye(y.shape[1]), y.T @ r)
    return out


@pytest.mark.parametrize("chunk", [7, 100, 1 << 16])
def test_equals_a_dense_solve(spark, chunk):
    ratings = table(spark)
    factors = als.fit(ratings, rank=5, iterations=2, blocks=2).itemFactors
    got = {r.id: r.features for r in foldin.fold_in(factors, ratings, 0.05, chunk=chunk).collect()}
    want = dense(factors, ratings.select("uid", "mid", "score").collect(), 0.05)
    assert got.keys() == want.keys()
    for u, features in got.items():
        assert features == pytest.approx(want[u].tolist(), abs=1e-9)


def test_known_users_get_the_factors_of_the_fit(spark):
    """A fit ends with the users' step, so folding its own ratings in repeats that step."""
    ratings = table(spark, 1)
    model = als.fit(ratings, rank=4, iterations=3, reg=0.1, blocks=2)
    got = {r.id: r.features for r in foldin.fold_in(model.itemFactors, ratings, 0.1, chunk=50).collect()}
    for r in model.userFactors.collect():
        assert got[r.id] == pytest.approx(r.features, abs=2e-4)


def test_movies_fold_in_against_users(spark):
    ratings = table(spark, 2)
    model = als.fit(ratings.where("mid > 5"), rank=3, iterations=2, blocks=2)
    new = ratings.where("mid <= 5")
    got = {r.id: r.features for r in foldin.fold_in(model.userFactors, new, 0.01, new="mid", known="uid").collect()}
    want = dense(model.userFactors, new.select("mid", "uid", "score").collect(), 0.01)
    assert got.keys() == want.keys() == {1, 2, 3, 4, 5}
    for m, features in got.items():
        assert features == pytest.approx(want[m].tolist(), abs=1e-9)


def test_unseen_users_get_predictions_after_folding_in(spark):
    ratings = table(spark, 3)
    model = als.fit(ratings.where("uid % 4 <> 0"), rank=3, iterations=4, reg=0.05, blocks=2)
    unseen = ratings.where("uid % 4 = 0").select("uid", "mid", "score")
    assert als.predict(model, unseen).count() == 0
    scored = foldin.predict(foldin.fold_in(model.itemFactors, unseen, 0.05), model.itemFactors, unseen)
    assert scored.columns == ["uid", "mid", "score", "prediction"] and scored.count() == unseen.count()
    errors = [(r.score - r.prediction) ** 2 for r in scored.collect()]
    spread = np.var([r.score for r in unseen.collect()])
    assert np.mean(errors) < spread / 4


def test_odd_rows(spark):
    factors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [float("nan"), 1.0]), (4, None)], "id int, features array<float>")
    rows = [(1, 1, 2.0), (1, 1, 4.0), (1, 2, 1.0), (2, 3, 5.0), (3, 9, 5.0), (None, 1, 1.0), (4, 1, None), (5, 2, 3.0), (5, None, 3.0)]
    ratings = spark.createDataFrame(rows, "uid long, mid int, score double")
    got = {r.id: r.features for r in foldin.fold_in(factors, ratings, 0.5, chunk=2).collect()}
    assert got.keys() == {1, 5}
    assert got[1] == pytest.approx([6 / (2 + 1.5), 2 / (4 + 1.5)]) and got[5] == pytest.approx([0, 6 / 4.5])
    assert foldin.fold_in(factors, ratings.limit(0)).collect() == []
    assert foldin.fold_in(factors.limit(0), ratings).collect() == []
    plain = foldin.fold_in(factors, ratings.where("uid = 1 AND mid = 1"), 0.0)  # singular without a penalty
    assert plain.first().features == pytest.approx([3.0, 0.0])


def test_a_hot_user_is_dealt_over_tasks(spark):
    """With a third of all ratings, no partition of the first sums holds more than its chunk."""
    ratings = table(spark, 4, hot=3000)
    factors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(25)], "id int, features array<double>")
    out = foldin.fold_in(factors, ratings, 0.1, chunk=500)
    assert out.where("id = 1").count() == 1
    plan = plan_of(out)
    assert "hashpartitioning(id" in plan and "part" in plan and "CartesianProduct" not in plan


def test_single_precision_is_shuffled_as_it_is(spark):
    """A vector is sent for each pair, so it is not made twice as long before."""
    ratings = table(spark, 5)
    single = spark.createDataFrame([(i, [i / 3, 1.0]) for i in range(25)], "id int, features array<float>")
    out = foldin.fold_in(single, ratings, 0.1)
    assert "array<double>" not in plan_of(out) and "cast(features" not in plan_of(out)
    got, want = {r.id: r.features for r in out.collect()}, dense(single, ratings.select("uid", "mid", "score").collect(), 0.1)
    assert got.keys() == want.keys() and all(v == pytest.approx(want[u].tolist(), abs=1e-9) for u, v in got.items())
