from __future__ import annotations

import os
import random

import numpy as np
import pytest

from marquee.operators import pagerank
from marquee.session import scratch_dir


def dense(edges, seeds, damping, rounds):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | {n for n, _ in seeds})
    at = {n: i for i, n in enumerate(nodes)}
    move = np.zeros((len(nodes),) * 2)
    for a, b, w in edges:
        move[at[b], at[a]] += w
    out = move.sum(0)
    move = move / np.where(out > 0, out, 1)
    start = np.zeros(len(nodes))
    for n, w in seeds:
        start[at[n]] += w
    start /= start.sum()
    rank = start
    for _ in range(rounds):
        got = move @ rank
        rank = (1 - damping + damping * (1 - got.sum())) * start + damping * got
    return {n: rank[at[n]] for n in nodes if rank[at[n]] > 0}


def frames(spark, edges, seeds):
    return spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "node string, weight double")


def test_equals_dense_rounds_with_dangling_nodes(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randint(1, 30)}", f"n{rng.randint(1, 45)}", rng.randint(1, 9) / 2) for _ in range(120)]
    edges += [(f"n{i}", "hub", 1.0) for i in range(1, 30)]  # everything leads to it, and nothing on
    edges += edges[:9]
    seeds = [("n1", 1.0), ("n2", 3.0), ("alone", 1.0), ("n1", 1.0)]
    got = {r.node: r["rank"] for r in pagerank.pagerank(*frames(spark, edges, seeds), rounds=4, tolerance=0).collect()}
    want = dense(edges, seeds, 0.85, 4)
    assert got.keys() == want.keys() and sum(got.values()) == pytest.approx(1)
    for node, value in want.items():
        assert got[node] == pytest.approx(value, abs=1e-12)


def test_stops_when_ranks_stand(spark):
    edges, seeds = [("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 1.0)], [("a", 1.0)]
    before = set(os.listdir(scratch_dir(spark))) if os.path.exists(scratch_dir(spark)) else set()
    ranks = pagerank.pagerank(*frames(spark, edges, seeds), tolerance=1e-6, rounds=500)
    got = {r.node: r["rank"] for r in ranks.collect()}
    assert got == pytest.approx({"a": 1 / 1.85, "b": 0.85 / 1.85}, abs=1e-5)
    assert len(set(os.listdir(scratch_dir(spark))) - before) == 1  # only the ranks are left


def test_odd_rows(spark):
    edges = [("a", None, 1.0), (None, "a", 1.0), ("a", "b", 0.0), ("a", "b", None), ("a", "c", 2.0)]
    got = {r.node: r["rank"] for r in pagerank.pagerank(*frames(spark, edges, [("a", 1.0), (None, 1.0)]), rounds=1).collect()}
    assert got == pytest.approx({"a": 0.15, "c": 0.85})
    assert pagerank.pagerank(*frames(spark, edges, []), rounds=2).collect() == []
    assert {r.node: r["rank"] for r in pagerank.pagerank(*frames(spark, [], [("a", 2.0)])).collect()} == {"a": 1.0}
