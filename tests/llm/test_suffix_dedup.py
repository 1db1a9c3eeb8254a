from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import stages, suffix_dedup
from marquee.llm.suffixes import suffix_array


def brute_force(texts: list[bytes], length: int, words: int = 0) -> list[bytes]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        for start, end in zip(edges[::2], edges[1::2]):
            if len(t[start:end].split()) < words:
                gone[start:end] = False
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def test_suffix_array_orders_all_suffixes():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.3 and s:
            s = (s[: rng.randint(1, 6)] * 20)[: len(s)]
        assert suffix_array(np.array(s, int)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def corpus(seed: int, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "é", "the", "漢", "x", "zz top", "\n"])
    prose = lambda k: " ".join(word() + str(rng.randint(0, 9)) for _ in range(k))
    shared = [prose(12), prose(30), prose(60), "=" * 150]
    texts = []
    for _ in range(n):
        parts = [prose(rng.randint(0, 25)) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        texts.append("".join(parts))
    texts += texts[:5] + [t.replace("the", "thy", 1) for t in texts[:15]]
    return [*texts, "", None, "short"]


@pytest.mark.parametrize(("seed", "most"), [(1, 4096), (2, 3), (3, 2)])
def test_removes_what_brute_force_removes(spark, seed, most):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs, 64, most=most).collect()}
    raw = [(t or "").encode() for t in texts]
    assert len(got) == len(texts)
    for i, kept in enumerate(brute_force(raw, 64)):
        assert bytes(got[i].kept) == kept, i
        assert got[i].n_bytes == len(raw[i])
        assert sum(s.end - s.start for s in got[i].spans) == len(raw[i]) - len(kept)


def test_repeated_rows_null_keys_and_extra_columns(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(1, text, 5), (1, text, 6), (None, "other " + text, 7), (2, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ranges int")
    got = suffix_dedup.dedup(docs, 64).collect()
    assert sorted((r.doc_id or 0, bytes(r.kept)) for r in got) == [(0, b"other "), (1, b""), (1, b""), (2, b"")]
    written = suffix_dedup.rewrite(docs, 64)
    assert written.columns == docs.columns
    assert sorted((r.ranges, r.text) for r in written.collect()) == [(5, ""), (6, ""), (7, "other "), (8, None)]


def test_the_stage_finds_passages_of_over_fifty_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = {n: prose(n) for n in range(51, 81)}
    short = prose(30)
    texts = [f"{prose(40)}. {passage} {prose(rng.randint(20, 90))}" for passage in passages.values() for _ in range(3)]
    clean = [f"{prose(60)} {short} {prose(60)}" for _ in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts + clean)], schema)
    got = {r.doc_id: r for r in stages.suffix_array_dedup(spark, docs, "").collect()}
    for i, text in enumerate(texts):
        passage = list(passages.values())[i // 3]
        rest = text.replace(passage, " ").split()
        # Beside the passage goes what its three places have in common before and after it.
        assert len(set(got[i].text.split()) & set(rest)) >= len(rest) - 3
        assert not set(got[i].text.split()) & set(passage.split()[1:-1]) - set(rest)
        assert got[i].n_chars == len(got[i].text)
    assert [got[len(texts) + i].text for i in range(40)] == clean


def test_columns_of_any_name_come_back(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, "a " + text), (2, "b " + text)], "doc_id long, text string")
    names = ["rid", "__rid", "ranges", "__ranges", "ranges_", "row", "unit", "scope", "key", "start"]
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.col("doc_id") + i)
    written = suffix_dedup.rewrite(docs, 64)
    assert written.columns == docs.columns
    assert sorted(map(tuple, written.collect())) == [(i, f"{'ab'[i - 1]}", *range(i, i + len(names))) for i in (1, 2)]
    assert len(suffix_dedup.dedup(docs, 64).collect()) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(docs).collect() == []


def test_equal_anchors_without_a_repeated_window(spark):
    anchor = "0" * 32
    docs = spark.createDataFrame([(i, "".join(chr(65 + (i * k) % 50) for k in range(1, 30)) + anchor + "".join(chr(70 + (i * k) % 47) for k in range(1, 30))) for i in range(2, 9)], "doc_id long, text string")
    assert all(r.spans == [] for r in suffix_dedup.dedup(docs, 64).collect())
