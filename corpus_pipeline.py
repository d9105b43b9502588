"""Corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the
next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmetric.llm import covering, crf, packing, repetition, substring
from voxmetric.llm.queries import WORD_BPE
from voxmetric.llm.storage import small_batches, written

# A document whose best language holds less of its words than this is rejected.
MIN_LANGUAGE_SCORE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    small_batches(spark)
    return repetition.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from their own labels."""
    small_batches(spark)
    model = crf.train(docs.filter(~crf.held_out()))
    return crf.keep(docs, model, MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    small_batches(spark)
    return covering.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages; ``n_chars`` follows the text."""
    small_batches(spark)
    kept = substring.strip_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    small_batches(spark)
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

# Language ID, fingerprints and tokens have no SQL form; tests compare each
# stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
