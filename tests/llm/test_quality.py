from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np

from marquee.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text: str) -> tuple:
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    twice = len(lines) - len(set(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, twice, len(covered), failed


def corpus(n: int) -> list[str | None]:
    rng = random.Random(2)
    words = "a bé the $x 漢字 end. | #tag \x0bq \x1c".split(" ")
    texts = ["".join(rng.choice(words) + rng.choice(" \n\t ") for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*texts, "", None, " \n ", "one two three four five " * 4, "x" * 5000, "w " * 30_000]


def test_counts_against_the_definition(spark):
    texts = corpus(150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = quality.fit([], [])
    got = {r.doc_id: r for r in quality.assess(docs, field).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert found == plain_counts(text or ""), text
        assert len(r.labels) == (text or "").count("\n") + 1
        assert r.kept == (not r.base_failed)
    assert got[len(texts) - 1].n_repeat_words == 30_000


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        x = rng.normal(size=(n, quality.FEATURES))
        field = quality.Field(rng.normal(size=quality.FEATURES), 0.3, rng.normal(size=(2, 2)), rng.normal(size=2))

        def total(labels):
            score = field.first[labels[0]]
            score += sum((x[t] @ field.weights + field.bias) * y for t, y in enumerate(labels))
            return score + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert tuple(map(int, field.decode(x))) == best


def test_likelihood_gradient_learns_to_tell_lines_apart():
    rng = random.Random(4)
    good = ["\n".join("plain words in a line of text." for _ in range(rng.randint(1, 9))) for _ in range(40)]
    bad = ["\n".join("buy!! | now### | $$$ %%%" for _ in range(rng.randint(1, 9))) for _ in range(40)]
    features = [np.array(quality.lines_of(t)[0]) for t in good + bad]
    field = quality.fit(features, [1] * 40 + [0] * 40)
    assert all(all(field.decode(f)) for f in features[:40])
    assert not any(any(field.decode(f)) for f in features[40:])


def test_training_keeps_to_the_sample_and_ignores_nulls(spark):
    rows = [(i, "fine words here. " * 3 if i % 2 else "### $$$ | %%%") for i in range(30)] + [(None, "x"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, quality int")
    field = quality.train(docs, labels, sample=20)
    kept = quality.keep(docs.selectExpr("doc_id", "repeat(text, 5) AS text", "1 AS kept"), field)
    assert kept.columns == ["doc_id", "text", "kept"]
    empty = docs.limit(0)
    assert quality.assess(empty, quality.train(empty, labels)).collect() == []


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    field = quality.train(docs, labels.where("doc_id % 3 > 0"))
    judged = quality.assess(docs, field).join(labels.where("doc_id % 3 = 0"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    good, bad = counts.get((1, True), 0), counts.get((0, False), 0)
    assert good > 0.97 * (good + counts.get((1, False), 0))
    assert bad > 0.9 * (bad + counts.get((0, True), 0))
