from __future__ import annotations

import numpy as np
import pytest
from conftest import plan_of

from marquee.operators import means
from marquee.sources import warehouse


@pytest.mark.parametrize("held_bytes", [200, means.HELD_BYTES])
def test_means_equal_a_plain_sum(spark, held_bytes, monkeypatch):
    """In one part and in many, with an id of many weights, unknown vectors and nulls."""
    rng = np.random.default_rng(2)
    vectors = {int(m): rng.normal(size=3).tolist() for m in range(30)} | {40: None}
    rows = {(int(u), int(m)) for u, m in rng.integers(0, 45, (200, 2))} | {(2**40, m) for m in range(30)} | {(99, 40)}
    rows = [(u, m, float(rng.integers(1, 50)) / 10) for u, m in sorted(rows)] + [(1, 1, None), (None, 2, 1.0), (3, None, 1.0), (98, 5, 0.0)]
    weights = spark.createDataFrame(rows, "id long, of int, weight double").repartition(3)
    known = spark.createDataFrame(list(vectors.items()), "id int, features array<double>").repartition(4)
    got = {r.id: r.features for r in means.weighted_means(weights, known, held_bytes).collect()}
    want = {}
    for u, m, w in rows:
        if None not in (u, m, w) and w and vectors.get(m):
            want.setdefault(u, []).append((w, vectors[m]))
    assert got.keys() == want.keys() and len(got) > 40
    for u, terms in want.items():
        assert got[u] == pytest.approx(np.average([v for _, v in terms], axis=0, weights=[w for w, _ in terms]).tolist(), rel=1e-12)


def test_no_vector_is_shuffled_for_a_rating(spark):
    from conftest import SMALL

    users = warehouse.user_vectors(spark, SMALL)
    assert users.dtypes == [("uid", "int"), ("features", "array<double>")]
    assert "Join" not in plan_of(users) and "Aggregate" not in plan_of(users)
    assert users.count() == warehouse.customer_ratings(spark, SMALL).select("uid").distinct().count()
