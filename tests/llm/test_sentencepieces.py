from __future__ import annotations

import random

import numpy as np
import pytest

from marquee.llm import sentencepieces


def corpus() -> list[str]:
    rng = random.Random(3)
    odd = ["", "  a  b", "\n\n a", "▁a", "a\x00b", "😀 x", "a▁▁b", " ", " ▁", "\n", "x" * 3000, " " * 200, "ab" * 40]
    odd += ["éè́ ñ<s></s><0x41><unk> b", "漢字かな交じり文" * 50, "<0x0A>\r\n\t"]
    return odd + ["".join(rng.choice(" \n▁abétheing😀漢.") for _ in range(rng.randint(0, 60))) for _ in range(2000)]


def test_ids_and_text_equal_the_library(spark):
    texts = corpus()
    model = sentencepieces.default_model()
    library = sentencepieces.Agenda(model).library
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in sentencepieces.encode_decode(docs, audit_every=1).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded == library.decode(ids)


def test_rows_and_heaps_agree():
    agenda = sentencepieces.Agenda(sentencepieces.default_model())
    segments = [s for t in corpus() for s in agenda.cut("▁" + t.replace(" ", "▁")) if len(s) <= sentencepieces.ROW]
    assert agenda.merge_rows(segments) == [agenda.merge(s) for s in segments]


def test_memory_is_bounded_and_a_difference_is_an_error(monkeypatch):
    agenda = sentencepieces.Agenda(sentencepieces.default_model())
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 50)
    for t in corpus()[:400]:
        list(agenda.run([t], 1))
        assert len(agenda.packed) <= 50 or len(t) > 50
    agenda.pair_id += 1
    with pytest.raises(ValueError):
        agenda.packed.clear()
        list(agenda.run(["a a a"], 1))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (1, "", 3), (None, "x", 4)], "doc_id long, text string, ids int")
    rows = sentencepieces.digests(sentencepieces.encode_decode(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 3), (1, 2), (1, 2)]
    assert sentencepieces.encode_decode(docs.limit(0)).collect() == []
