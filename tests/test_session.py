"""Scratch tables and their removal."""

from __future__ import annotations

import os

from marquee.operators import nearest
from marquee.session import clear_scratch, local_session, scratch, scratch_dir, scratch_path


def test_scratch_is_removed_at_the_end_of_its_block(spark):
    with scratch(spark, "some") as path:
        spark.range(3).write.parquet(path)
        assert os.path.dirname(path) == scratch_dir(spark)
        assert spark.read.parquet(path).count() == 3
    assert not os.path.exists(path)


def test_clearing_leaves_nothing(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("marquee.session.shared_dir", lambda session: str(tmp_path))
    for name in ("a", "b"):
        spark.range(1).write.parquet(scratch_path(spark, name))
    assert len(os.listdir(scratch_dir(spark))) == 2
    clear_scratch(spark)
    assert os.listdir(tmp_path) == []


def test_a_search_leaves_nothing(spark):
    before = set(os.listdir(scratch_dir(spark))) if os.path.exists(scratch_dir(spark)) else set()
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id int, features array<double>")
    assert nearest.top_k_by_product(df, df, 2).count() == 9
    after = set(os.listdir(scratch_dir(spark))) if os.path.exists(scratch_dir(spark)) else set()
    assert before == after


def test_checkpoints_are_cleaned():
    assert local_session().conf.get("spark.cleaner.referenceTracking.cleanCheckpoints") == "true"
