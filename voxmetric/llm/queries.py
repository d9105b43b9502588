"""One query per operator over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covering, crf, crosspolytope, infill, packing, pivots, ppm, repetition, reputation, segments, substring, tallies, unigram
from .sieve import sieve
from .storage import scratch, small_batches
from .twins import SQL  # noqa: F401

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(_read(spark, sf_dir, "documents"))


def op2_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(_read(spark, sf_dir, "documents"), PIECES)


def op3_token_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted with counts of one tokenizer; then toxic ones deleted and
    bad ones counted anew by another one, in a batch that is committed twice.

    Texts are counted where they are read; only ids and counts are joined to the labels.
    """
    documents = _read(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.lit(0).alias("seq")
    )

    def counted(rows: DataFrame, op: str, path: str) -> DataFrame:
        version = F.lit(path.rpartition("/")[2].partition(".")[0])
        return rows.withColumns({"op": F.expr(op), "version": version, "n_tokens": tallies.token_count("text", path)})

    kept = tallies.Tallies(spark, scratch(spark, "tallies"))
    kept.commit(1, counted(documents, "'insert'", WORD_BPE))
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").filter("toxic = 1 or quality = 0")
    wanted = sieve(labels.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id")
    recounted = counted(documents.filter(wanted(F.col("doc_id").cast("bigint"))), "'revise'", PIECES).drop("text")
    second = recounted.join(labels, "doc_id").withColumn("op", F.expr("if(toxic = 1, 'delete', op)"))
    for _ in range(2):
        kept.commit(2, second)
    return kept.totals()


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").withColumn("held_out", crf.held_out())
    model = crf.train(documents.filter(~F.col("held_out")))
    return crf.identify(documents, model, ["doc_id", "held_out"])


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_read(spark, sf_dir, "documents").withColumn("held_out", ppm.held_out()))


def op6_packing_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), WORD_BPE)


def op7_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.strip_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering.classes(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is the quality label of its number: 0 is bad."""
    outcomes = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    judged = reputation.judge(_read(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = crosspolytope.Index(_read(spark, sf_dir, "embeddings"))
    return index.search(index.queries(F.col("vec_id") % 20 == 0))


def op12_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.with_inertia(*pivots.clusters(_read(spark, sf_dir, "embeddings")))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_repetition, op2_unigram_pieces, op3_token_tallies, op4_language_crf, op5_ppm_score,
        op6_packing_lp, op7_segment_top_k, op8_substring_dedup, op9_simhash_covering, op10_host_reputation,
        op11_cross_polytope, op12_laesa_clusters, op13_infill,
    )
}
