"""A training corpus from raw documents: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.common import read, table
from arborspark.llm.queries import vocabulary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    from arborspark.llm.toxicity import drop_toxic

    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    from arborspark.llm.simhash_dedup import deduplicate

    return deduplicate(docs).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and the character count follows; every document stays."""
    from arborspark.llm.secret_scan import redact

    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return redact(docs).withColumn("n_chars", length).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate says."""
    from arborspark.llm.mixing import mix

    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document that the mix emits."""
    from arborspark.llm.bpe_stream import encode_digests

    return encode_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash near-dedup", dedup), ("secret scan", secrets), ("source mixing", mixing), ("bpe", encode)]

#: Toxicity and SimHash have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"stage-{k}")
    return docs
