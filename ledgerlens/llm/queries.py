"""The registered queries of this subpackage: each applies one operator to its whole table."""
from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, best_fit, centroids, compression_quality, exact_dedup, lm_score, mixing, near_dedup, packing, quality_rules, substring_dedup, toxicity, warc
from .common import by_name
from .sql import FURTHER_ORACLES, ORACLES


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.mark(by_name(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.mark(by_name(spark, sf_dir, "documents"), by_name(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(by_name(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.mark(by_name(spark, sf_dir, "documents"), by_name(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc.write(by_name(spark, sf_dir, "pages"))
    return warc.records(warc.read(manifest, folder))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark(by_name(spark, sf_dir, "documents"), width=4)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.strip(by_name(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(by_name(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(by_name(spark, sf_dir, "documents"))


def _rounded_scores(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_scores(lm_score.score(by_name(spark, sf_dir, "documents")))


def op9_lm_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_scores(lm_score.score(by_name(spark, sf_dir, "documents"), order=2))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.mark(by_name(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.mark(by_name(spark, sf_dir, "documents"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.pack(by_name(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_compression_quality, op3_packing, op4_toxicity, op5_warc, op6_near_dedup, op7_substring_dedup, op8_mixing, op9_lm_score,
    op10_exact_dedup, op11_centroids, op12_tokenizer_alignment, op13_best_fit)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {name: sql for name, sql in ORACLES.items() if name in QUERIES}
#: Operators again, with other parameters.
FURTHER = {"op9_lm_score_pairs": op9_lm_score_pairs}
ALL_QUERIES, ALL_ORACLES = QUERIES | FURTHER, ORACLES | FURTHER_ORACLES
