from __future__ import annotations

from collections import Counter

import pytest

from marquee.llm import mixing


def documents(spark):
    rows = [(i, "w " * (i % 90), f"s{i % 3}" if i % 2 else "s0", i) for i in range(1, 900)]
    rows += [(7, "a b c", "s1", 1), (7, "a b c", "s1", 1), (None, "x y", None, 0), (5000, None, "s1", 0), (5001, "q", "tiny", 2), (5002, " ", "none", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target int")


@pytest.mark.parametrize("block", [7, 2048])
def test_targets_are_met_to_the_word(spark, block):
    docs = documents(spark)
    rows = mixing.mix(docs, block=block).collect()
    assert len(rows) == docs.count()
    assert sum(r.size for r in rows) * 1.5 == pytest.approx(sum({(r.source_size, r.target) for r in rows} and [t for _, t in {(r.source_size, r.target) for r in rows}]))
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    assert all(words == int(target) for (_, target), words in taken.items())
    again = mixing.mix(docs.repartition(5), block=block).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_slots_keep_to_the_shares_all_along(spark):
    sources = spark.createDataFrame([(0, "a", 600_000, 300_000.0), (1, "b", 100_000, 200_000.0), (2, "c", 900, 100_000 / 3)][:2],
                                    "number int, source string, source_size long, target double")
    slots = mixing.schedule(sources, 100).orderBy("slot").collect()
    assert len(slots) == 5000 and len({r.slot for r in slots}) == 5000
    seen = 0
    for i, r in enumerate(slots[:4800], 1):
        seen += r.number == 0
        assert abs(seen - 0.6 * i) < 6
    assert Counter((r.number, r["pass"]) for r in slots) == {(0, 0): 3000, (1, 0): 1000, (1, 1): 1000}


def test_mixed_rows_and_empty_table(spark):
    docs = documents(spark)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    sizes = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs).collect()}
    times = Counter(r.doc_id for r in rows.collect())
    assert all(times[i] == int(t / s + 0.5) for i, (s, t) in sizes.items() if s and i != 7)
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []


def test_null_ids_keep_to_their_source(spark):
    """A row without an id is taken by what its own source gives, even where sizes are equal."""
    rows = [(None, "a b c d", "x"), (None, "e f g h", "y")] + [(i, "w " * 9, "y") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = Counter(r.text for r in mixing.mixed(docs).collect() if r.doc_id is None)
    due = {r.source: r.taken for r in mixing.taken(docs).collect() if r.key is None}
    assert due["x"] == 8 and due["y"] in (4, 8)  # x is small: twice its size
    assert kept == {"a b c d": 2, "e f g h": due["y"] // 4}


def test_rows_without_an_id_are_dealt_over_buckets(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "s") for i in range(300)], "doc_id long, text string, source string")
    assert mixing.sized(docs).select("place").distinct().count() == 300
    rows = mixing.taken(docs).collect()
    assert len(rows) == 300 and sum(r.taken for r in rows) == 900


def test_columns_of_any_name_come_back(spark):
    names = ("__words", "__times", "__key", "__size", "__again", "row", "place", "size", "times", "share", "number", "target", "taken")
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(4)], "doc_id long, text string, source string")
    for name in names:
        docs = docs.withColumn(name, docs["doc_id"] * 10)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    assert {tuple(r) for r in rows.collect()} <= {(i, "a b c", "s", *[i * 10] * len(names)) for i in range(4)}
    assert rows.count() >= 4
