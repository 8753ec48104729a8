"""A corpus pipeline: stages over documents, each written as Parquet before the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import exactdedup, langid, packing, pii, similar
from corvid.llm.common import cut
from corvid.llm.queries import WORD_BPE, pii_key
from corvid.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null text, or no letter in it. ``lang`` stays as it was."""
    ship(spark)
    return langid.with_letters(spark, docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for case of A-Z, the row with the largest doc_id stays."""
    ship(spark)
    return exactdedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (SimHash over five words, similarity 0.8 or more), the row with the smallest doc_id stays."""
    ship(spark)
    return similar.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars follows the text."""
    out, _ = pii.replace(docs, pii_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 tokens."""
    ship(spark)
    return packing.best_fit_pack(docs, WORD_BPE)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]

# SQL expresses neither language, SimHash components nor packing; tests/llm/test_pipeline.py holds each stage, and run(), against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
