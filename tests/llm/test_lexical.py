from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from marquee.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(documents, items, k):
    """Every document against every item."""
    bags = [Counter(terms_of(text)) for _, text in documents]
    count = sum(bool(bag) for bag in bags)
    total = sum(sum(bag.values()) for bag in bags)
    df = Counter(term for bag in bags for term in bag)
    weight = {term: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for term, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for (key, _), bag in zip(documents, bags):
            m = 100 - 90 + 90 * sum(bag.values()) * count // max(total, 1)
            score = sum(weight[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms_of(text)) if t in bag)
            if score:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, r, key, -score) for r, (score, _, _, key) in enumerate(sorted(scores)[:k], 1)]
    return out


def ranked(spark, documents, items, **options):
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in lexical.rank(docs, asked, **options).select("item_id", "rank", "doc_id", "score").collect()]


order = lambda row: tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize("rounds", [(1.0,), (1 / 64, 1 / 8, 1.0)])
@pytest.mark.parametrize("weak", [0.5, 1.0])
def test_equals_plain_scoring(spark, monkeypatch, rounds, weak):
    monkeypatch.setattr(lexical, "WEAK", weak)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    chances = [1 / (i + 1) for i in range(60)]
    documents = [(i, " ".join(rng.choices(words, chances, k=rng.choice((3, 10, 30, 200))))) for i in range(250)]
    documents += [(1000 + i, documents[0][1]) for i in range(120)]  # a large group of copies
    documents += [(5, "w59 w58"), (5, "w59 w58"), (None, "w59 w58"), (2000, None), (2001, ""), (2002, "w0 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(12, documents[0][1]), (12, "w59 W58"), (13, None), (14, "unheard"), (None, "w3")]
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(docs)
    got = [tuple(r) for r in lexical.search(index, asked, 10, rounds=rounds).select("item_id", "rank", "id", "score").collect()]
    assert sorted(got, key=order) == sorted(plain(documents, items, 10), key=order)


def test_terms_and_lower_case(spark):
    documents = [(1, "Émile ÉMILE don't_a1"), (2, "日本 語x A1"), (3, " x  K K")]
    for _, text in documents:
        assert [t.decode() for t in lexical.terms_of(text.encode())] == terms_of(text)
    items = [(1, "émile ÉMILE"), (2, "a1 語X"), (3, "K K")]
    assert sorted(ranked(spark, documents, items)) == sorted(plain(documents, items, 10))


def test_index_of_asked_terms_equals_the_whole(spark):
    documents = [(i, f"a b{i % 7} c{i % 3} " * (1 + i % 5)) for i in range(60)]
    items = [(1, "a b1"), (2, "c2 b6 zzz")]
    docs, asked = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = lexical.search(lexical.build(docs), asked, 4).select("item_id", "rank", "id", "score")
    assert sorted(map(tuple, whole.collect())) == sorted(ranked(spark, documents, items, k=4)) == sorted(plain(documents, items, 4))


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1)], "doc_id long, text string, row int")
    for name in ("id", "term", "tf", "n", "m", "item", "key", "score", "rank", "weak"):
        docs = docs.withColumn(name, docs["row"])
    asked = docs.selectExpr("doc_id AS item_id", "text", "row", "item", "key", "term")
    assert lexical.rank(docs.limit(0), asked).collect() == []
    assert lexical.rank(docs, asked.limit(0)).collect() == []
    assert len(lexical.rank(docs, asked).collect()) == 1


def test_strata_are_left_out_by_their_bound(spark):
    """With short documents on top, the strata of long ones are never visited."""
    documents = [(i, "rare common") for i in range(40)] + [(100 + i, "common " * 400) for i in range(40)]
    docs, asked = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame([(1, "rare common")], "item_id long, text string")
    index = lexical.build(docs)
    plan = lexical.planned(index, lexical.item_terms(asked.selectExpr("0L AS item", "text"))).collect()
    strata = {r.m: (r.bound, r.round) for r in plan}
    assert len(strata) == 2 and strata[min(strata)][1] == 0 and strata[max(strata)][1] == 2
    best = [tuple(r) for r in lexical.search(index, asked, 10).select("rank", "id", "score").orderBy("rank").collect()]
    assert [i for _, i, _ in best] == list(range(10)) and best[0][2] > strata[max(strata)][0]
