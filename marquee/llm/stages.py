"""The stages of the corpus pipeline: functions of (spark, docs, sf_dir).

All but the last return the columns of ``documents``; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import mixing, quality, sentencepieces, simhash, suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the rules; the field is trained on labelled documents of the stage."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one whose key names the class.

    Of rows with that key, one stays; rows without a key stay only where their class has none
    with a key, and then one of them.
    """
    return simhash.one_of_each(docs)


#: A passage of over 50 words repeats: strings of so many bytes are looked for, as nearly all
#: such passages have more, and runs of so many words are removed.
REPEATED_BYTES, REPEATED_WORDS = 240, 50


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the long passages that repeat; documents left empty go."""
    kept = suffix_dedup.rewrite(docs, REPEATED_BYTES, words=REPEATED_WORDS)
    return kept.where(F.length("text") > 0).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, counting passes that take half its words."""
    return mixing.mixed(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest columns of the encoded documents, a row for each."""
    return sentencepieces.digests(sentencepieces.encode_decode(docs))
