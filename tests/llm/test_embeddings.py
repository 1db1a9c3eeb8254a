from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import embeddings


def expected(vectors: np.ndarray, threshold: float = 0.95):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    component = np.arange(len(vectors))
    while True:
        least = np.minimum(component, np.where(linked, component[None, :], len(vectors)).min(1))
        least = least[least]
        if (least == component).all():
            return linked.sum(1), component
        component = least


def corpus(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 24))
    rows = [rng.normal(size=(200, 24)), np.repeat(centres[:1], 40, 0)]
    for i, centre in enumerate(centres):
        rows.append(centre + rng.normal(size=(1 + i % 7, 24)) * 0.15)
    rows.append(centres[1] + rng.normal(size=(150, 24)) * 0.2)  # a large group, not all linked
    walk = centres[2] + np.cumsum(rng.normal(size=(30, 24)) * 0.1, axis=0)  # a chain
    return np.concatenate([*rows, walk]).astype(np.float32)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_classes_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(embeddings, "COUNTED", 64)
    vectors = corpus(seed)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    links, component = expected(vectors.astype(np.float64))
    assert got[0].recall >= embeddings.RECALL
    found = [got[i].component for i in range(len(vectors))]
    assert np.mean([a == b for a, b in zip(found, component)]) > 0.99
    assert sum(got[i].n_links for i in range(len(vectors))) >= 0.99 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(len(vectors)))


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1),
            (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [1.0], 1), (9, [], 1), (None, [1.0, 0.0], 1),
            (2, [2.0, 0.0], 1), (10, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")
    got = sorted((r.vec_id or 0, r.n_links, r.component) for r in embeddings.near_duplicates(df).collect())
    alone = [(i, 0, i) for i in range(3, 10)]
    assert got == [(0, 0, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), *alone, (10, 3, 1)]
    assert embeddings.near_duplicates(df.limit(0)).collect() == []
    assert [r.n_links for r in embeddings.near_duplicates(df.where("vec_id = 3")).collect()] == [0]


def test_first_lists_hold_far_neighbours_and_all_of_a_full_bucket(spark, monkeypatch):
    agree = 1 - np.arccos(embeddings.THRESHOLD) / np.pi
    assert all(1 - (1 - agree**bits) ** embeddings.tables(bits) >= 0.99 for bits in range(1, 40))
    names = spark.range(100).selectExpr("id AS node", "id % 2 AS side")
    blocks = {}
    for r in embeddings._blocks(names, "side", 8, whole=True).collect():
        blocks.setdefault(r.block, []).append(r.node)
    met = {(a, b) for block in blocks.values() for a in block for b in block}
    assert met == {(a, b) for a in range(100) for b in range(100) if a % 2 == b % 2}
    vectors = np.random.default_rng(3).normal(size=(60, 24))  # no two within a cosine of 0.8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    nodes = embeddings.nodes_of(df, "vec_id", "embedding")
    lists = embeddings.best(embeddings.by_signs(nodes, 60, 0), 0).groupBy("u").count().collect()
    assert len(lists) == 60 and all(r["count"] == embeddings.LIST for r in lists)


def test_subgroups_that_fill_all_lists_are_one_class(spark):
    rng = np.random.default_rng(5)
    first, second = np.linalg.qr(rng.normal(size=(24, 2)))[0].T
    turned = 0.96 * first + np.sqrt(1 - 0.96**2) * second
    rows = [centre + rng.normal(size=(300, 24)) * 0.002 for centre in (first, turned)]
    vectors = np.concatenate(rows)  # all linked, across at a cosine of 0.96
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    links, component = expected(vectors)
    assert set(component) == {0} and set(links) == {599}
    got = embeddings.near_duplicates(df).collect()
    assert {r.component for r in got} == {0} and {r.n_links for r in got} == {599}


def test_audit_sees_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(6)
    large = rng.normal(size=24) + rng.normal(size=(300, 24)) * 0.01
    pairs = np.repeat(rng.normal(size=(20, 24)), 2, axis=0) + rng.normal(size=(40, 24)) * 0.01
    vectors = np.concatenate([large, pairs])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    nodes = spark.createDataFrame(rows, "node long, vec array<double>")
    one = [(i, 0) for i in range(300)]
    two = [(i, i - i % 2) for i in range(300, 340)]
    classes = lambda rows: spark.createDataFrame(rows, "node long, component long")
    assert embeddings.audit(nodes, classes(one)) == 0
    assert embeddings.audit(nodes, classes(one + two[:20])) == pytest.approx(0.5)
    assert embeddings.audit(nodes, classes(one + two)) == 1


def test_only_pairs_with_a_fresh_entry_that_a_list_takes_are_given():
    vec = [[1.0, 0.0], [0.98, 0.2], [0.9, 0.4], [0.0, 1.0]]
    schema = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("vec", pa.list_(pa.float64())), ("fresh", pa.bool_()), ("bar", pa.float64())])

    def given(fresh, bar, most=16):
        batch = pa.record_batch([[1] * 4, [10, 11, 12, 13], vec, fresh, bar], schema=schema)
        rows = [tuple(r.values()) for out in embeddings._compare(most)([batch]) for r in out.to_pylist()]
        return {r[:2] for r in rows if r[2] is not None}, {r[:2] for r in rows if r[2] is None}

    every = {(a, b) for a in range(10, 14) for b in range(10, 14) if a != b}
    # 10 - 11 and 11 - 12 are links, 10 - 12 is none: one class.
    assert given([True] * 4, [-2.0] * 4) == (every, {(10, 11), (10, 12)})
    assert given([False, False, False, True], [-2.0] * 4)[0] == {p for p in every if 13 in p}
    assert given([True] * 4, [0.9, 2.0, 0.95, 2.0])[0] == {(10, 11), (10, 12), (12, 11)}
    # A list of one hides a link, the class does not.
    near, same = given([True] * 4, [-2.0] * 4, most=1)
    assert len(near) == 4 and same == {(10, 11), (10, 12)}


def test_entries_are_old_after_a_round(spark):
    rows = [(1, 2, 0.5, True), (1, 2, 0.5, False), (1, 3, 0.7, False), (1, 4, None, False)]
    pairs = spark.createDataFrame(rows, "u long, v long, cos double, old boolean")
    assert sorted((r.v, r.fresh, r.rank) for r in embeddings.best(pairs, 0).collect()) == [(2, False, 2), (3, True, 1)]


def test_attempts_end(spark, monkeypatch):
    tries = []
    monkeypatch.setattr(embeddings, "audit", lambda *a, **k: tries.append(k["attempt"]) or 0.5)
    monkeypatch.setattr(embeddings, "ATTEMPTS", 2)
    vectors = np.random.default_rng(8).normal(size=(20, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="0.5000"):
        embeddings.near_duplicates(df)
    assert tries == [0, 1]


def test_two_vectors_with_one_digest_are_two_nodes(spark, monkeypatch):
    plain = embeddings.nodes_of

    def clash(vectors, key, vector, salt=0):
        nodes = plain(vectors, key, vector, salt)
        return nodes if salt else nodes.withColumn("node", F.lit(7).cast("long"))

    monkeypatch.setattr(embeddings, "nodes_of", clash)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.01])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (2, 0, 2), (3, 1, 1)]
