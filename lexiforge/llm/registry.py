"""Queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import bpe, fingerprints, jaccard, langid, licenses, lm, mixing, quality, sharding, warc
from lexiforge.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with the multilingual ranks and decoded again."""
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % takes of each document."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-mixing scores of every document."""
    return lm.score(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard index of 0.9 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards whose row counts differ by one at most."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "n_spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC bundles, then read back from them."""
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def queries() -> dict[str, Query]:
    """Name -> query."""
    return {f.__name__: f for f in (op1_byte_bpe, op2_license_scan, op3_mix_sources, op4_lm_scores, op5_fingerprints, op6_jaccard_join, op7_sharding, op8_language_id, op9_quality_rules, op10_warc)}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, where SQL can express the query on whole tables."""
    return {}
