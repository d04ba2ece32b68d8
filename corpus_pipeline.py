"""Corpus cleaning: five stages over ``documents``, each a Parquet table that the next one reads.

Quality rejects go, one document of each near-duplicate group stays, documents
that hold benchmark passages go, secrets are replaced, and what is left is
encoded. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontamination, neardup, quality, secrets
from tidelog.llm.shared import read, release, settle, settled, settling


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more."""
    return neardup.dedup(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, read(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("bpe", encoding_stage),
]

#: SQL cannot express a trained classifier, a tagger or BPE; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage has settled goes once its result is written, the result once the next one is; all of it goes if a stage fails.

    Null and empty texts, repeated rows, very long texts, null ids and columns of any name are kept or dropped by the stages'
    own rules and pass through whole; of near copies without an id one row stays. An empty table gives an empty result.
    """
    docs, mark = read(spark, sf_dir, "documents"), settled()
    with settling(spark, always=False):
        for name, stage in STAGES:
            docs = settle(stage(spark, docs, sf_dir), name)
            release(spark, mark, keep=1)
    return docs
