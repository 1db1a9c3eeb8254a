from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from marquee.llm import simhash
from marquee.llm.components import components


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points: list[int], distance: int = 4) -> list[int]:
    least = list(range(len(points)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= distance:
                x, y = sorted((root(i), root(j)))
                least[y] = x
    return [root(i) for i in range(len(points))]


def corpus(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: rng.choice("Alpha bêta GAMMA delta Épsilon zeta eta theta iota kappa".split())
    texts = [rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.randint(0, 300))) for _ in range(n)]
    for t in texts[: n // 2]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return [*texts, *texts[:5], "", None, "  x y", "one two", "A B c\x1cd e"]


def test_fingerprints_and_classes(spark):
    texts = corpus(1, 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    points = [plain_fingerprint(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == points
    assert [got[i].component for i in range(len(texts))] == classes(points)


@pytest.mark.parametrize("n", [10, 64, 65, 300, 3000])
def test_shard_links_connect_what_brute_force_does(n):
    rng = random.Random(n)
    centres = [rng.getrandbits(64) for _ in range(max(2, n // 40))]
    points = set()
    while len(points) < n:
        p = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7, 9, 30])):
            p ^= 1 << rng.randrange(64)
        points.add(p)
    points = sorted(points)
    a, b = simhash.shard_links(np.zeros(n, np.int64), np.array(points, np.uint64))
    at = {p: i for i, p in enumerate(points)}
    links = [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]
    expected = classes(points)
    least = list(range(n))
    for _ in range(n):
        before = list(least)
        for x, y in links:
            least[x] = least[y] = min(least[x], least[y])
        if before == least:
            break
    assert least == expected


def test_shards_hold_every_near_pair(spark):
    rng = random.Random(5)
    points = []
    for _ in range(200):
        p = rng.getrandbits(64)
        q = p
        for b in rng.sample(range(64), 4):
            q ^= 1 << b
        points += [p, q]
    signed = [(p - 2**64 if p >> 63 else p,) for p in points]
    for n, most in ((10, 1 << 16), (5000, 1 << 16), (1 << 20, 1 << 16), (1 << 34, 1 << 16), (10, 2), (5000, 2)):
        rows = simhash.sharded(spark.createDataFrame(signed, "fp long"), simhash.masks(n), most).collect()
        shards = {}
        for r in rows:
            shards.setdefault(r.fp % 2**64, set()).add(r.shard)
        assert all(shards[points[i]] & shards[points[i + 1]] for i in range(0, len(points), 2))


def test_shards_hold_enough_points_for_a_tree():
    for n in (10, 1000, 1024):
        assert simhash.masks(n) == [0]
    for n in (1025, 50_000, 256_000, 4_000_000, 16_000_000, 1 << 25, 1 << 30):
        chosen = simhash.masks(n)
        (agreed,) = {mask.bit_count() for mask in chosen}
        assert simhash.LEAF < simhash.TREE // 2 <= n >> agreed <= simhash.EXPECTED
        assert len(set(chosen)) == len(chosen)


@pytest.mark.parametrize("n", [1000, 5000])
def test_the_trees_find_the_pairs(n, monkeypatch):
    """Vantage points are asked, branches are left out, and the classes are those of brute force."""
    rng = random.Random(n)
    points = []
    while len(points) < n:
        p = rng.getrandbits(64)
        points.append(p)
        for b in rng.sample(range(64), rng.randint(1, 7)):
            points.append(p ^ 1 << b)
    points = sorted(set(points))
    asked, compared = [], [0]
    distance, compare = simhash.Forest.distance, simhash.Forest.compare

    def ask(self, i, members):
        asked.append(i)
        return distance(self, i, members)

    def block(self, ones, others):
        compared[0] += len(ones) * len(others)
        compare(self, ones, others)

    monkeypatch.setattr(simhash.Forest, "distance", ask)
    monkeypatch.setattr(simhash.Forest, "compare", block)
    links = []
    for mask in simhash.masks(len(points)):
        rows = sorted((p & mask, p) for p in points)
        names = {value: i for i, (value, _) in enumerate(rows)}
        shard = np.array([names[value] for value, _ in rows])
        a, b = simhash.shard_links(shard, np.array([p for _, p in rows], np.uint64))
        links += zip(a.tolist(), b.tolist())
    assert len(asked) > len(points) // 200 and compared[0]
    if n == 1000:
        assert compared[0] < len(points) ** 2
    at = {p: i for i, p in enumerate(points)}
    least = list(range(len(points)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in links:
        x, y = sorted((root(at[a]), root(at[b])))
        least[y] = x
    assert [root(i) for i in range(len(points))] == classes(points)


def test_long_chains_become_one_component(spark):
    links = [(i, i + 1) for i in range(1, 100)] + [(200, 201), (300, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 101)} | {200: 200, 201: 200}


def test_null_keys_repeated_rows_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, text, 1), (7, text, 1), (None, text, 2), (9, "another text that stands alone here", 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [(r.doc_id, r.component) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(7, 7), (7, 7), (None, 7), (9, 9), (None, None)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.fp for r in kept.collect()) == [1, 3, 4]


def test_columns_of_any_name_come_back(spark):
    docs = spark.createDataFrame([(1, "some text of five words"), (2, "some text of five words")], "doc_id long, text string")
    for name in ("name", "__name", "row", "fp", "kept", "component", "key", "digest"):
        docs = docs.withColumn(name, docs["doc_id"])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, "some text of five words", *[1] * 8)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
