from __future__ import annotations

import random

import pytest

from marquee.llm import edit_counts


@pytest.fixture(scope="module")
def counter():
    return edit_counts._counter(edit_counts.default_ranks(), edit_counts.default_pattern())


def test_counts_equal_a_new_encoding_after_every_edit(counter):
    rng = random.Random(1)
    bits = ["the", " ", "  ", "\n", "'", "'s", "ll", "re", "é", "漢字", "123", "!?", "don't", "\t", " a", "😀", "'ve"]
    make = lambda n: "".join(rng.choice(bits) for _ in range(n))
    for n in (0, 1, 5, 80, 700, 3000):
        for _ in range(12):
            text = make(n)
            tree = edit_counts.CountTree(text, counter)
            for _ in range(12):
                start, removed = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 60, 2000])
                inserted = make(rng.choice([0, 1, 2, 10, 400]))
                tree.edit(start, removed, inserted)
                text = text[:start] + inserted + text[start + removed :]
                assert tree.text() == text and tree.length == len(text)
                assert tree.tokens == len(counter.encoding.encode_ordinary(text))


def test_a_small_edit_of_a_long_text_encodes_little(counter):
    tree = edit_counts.CountTree("some words in a row. " * 20_000, counter)
    for at in (0, 7, 200_000, tree.length):
        tree.edit(at, 3, "new words")
    assert tree.reencoded < 60
    spaces = edit_counts.CountTree("a" + " " * 50_000 + "b", counter)
    spaces.edit(20_000, 1, "x")
    assert spaces.tokens == len(counter.encoding.encode_ordinary(spaces.text()))


def test_rows_edits_and_edges(spark):
    docs = spark.createDataFrame(
        [(1, "one two three", "a"), (1, "one two three", "b"), (2, None, "c"), (None, "", "d"), (3, "x", "e")],
        "doc_id long, text string, edits string",
    ).drop("edits")
    edits = spark.createDataFrame(
        [(1, 2, 0, 4, None), (1, 1, 3, 0, " more"), (2, 1, None, None, "new text"), (None, 1, 9, 9, "hello"), (9, 1, 0, 0, "y")],
        "doc_id long, seq int, start long, removed long, inserted string",
    )
    got = edit_counts.count_edited(edit_counts.with_edits(docs, edits)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens_before, r.n_tokens, r.n_chars) for r in got) == [
        (0, 0, 1, 5), (1, 3, 3, 14), (1, 3, 3, 14), (2, 0, 2, 8), (3, 1, 1, 1),
    ]
    assert edit_counts.count_edited(edit_counts.with_edits(docs.limit(0), edits)).collect() == []
