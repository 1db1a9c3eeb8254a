"""From raw documents to encoded training text: the stages in order, and the whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import stages
from marquee.session import remove, scratch_path

STAGES = [
    ("quality rules", stages.quality_rules),
    ("SimHash near-dedup", stages.simhash_dedup),
    ("suffix-array dedup", stages.suffix_array_dedup),
    ("mixing sources to target weights", stages.mixing_sources),
    ("SentencePiece encoding and decoding", stages.sentence_pieces),
]

#: SQL has no form of the labelling, the suffix arrays and the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again as the next input."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # read to its end by the stage just written
        before = path
    return docs
