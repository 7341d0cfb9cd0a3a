"""Queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, forest, gru, jaccard, mixing, quality, secrets, substrings, toxicity, warc

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SECRET_VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def fold(remainders: int, held: int) -> Column:
    """Whether doc_id belongs to the held-out fold; rows without an id don't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % remainders == held, F.lit(False))


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(_table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def toxic_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    labels = _table(spark, sf_dir, "labels")
    return toxicity.learn(toxicity.training_rows(_table(spark, sf_dir, "documents"), labels, ~fold(3, 1)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(_table(spark, sf_dir, "documents"), toxic_lexicon(spark, sf_dir))
    return scored.select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


def op6_gru_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score_documents(_table(spark, sf_dir, "documents"), fold(7, 2))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_documents(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(SECRET_VOCABULARY), public_tokenizers.PATTERN)


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_table(spark, sf_dir, "documents"))


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": op1_warc_index,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_recompression": op4_recompression,
    "op5_toxicity": op5_toxicity,
    "op6_gru_likelihood": op6_gru_likelihood,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_secret_scan": op8_secret_scan,
    "op9_rp_forest": op9_rp_forest,
    "op10_line_quality": op10_line_quality,
}

ORACLES: dict[str, str] = {"op1_warc_index": warc.ORACLE, "op3_pfair_mix": mixing.ORACLE, "op10_line_quality": quality.ORACLE}
