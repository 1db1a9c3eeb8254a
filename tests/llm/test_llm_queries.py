from __future__ import annotations

import pytest
from check_oracles import differences, oracle

from marquee.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, connection, name):
    assert differences(queries.queries()[name](spark, SF), connection, queries.oracle_sql()[name]) is None


def test_the_whole_pipeline_and_its_registration(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    names = set(queries.queries())
    assert {name.split("_")[0] for name in names} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    rows = queries.queries()["pipeline"](spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < rows.count() < 2 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_op5_scores_every_document(spark):
    rows = queries.queries()["op5_toxicity"](spark, SF)
    assert rows.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows.where("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.3 AS INT)").isEmpty()
