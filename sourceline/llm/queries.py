"""The training-data operators as queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from . import cover_tree, decontamination, embedding_dedup, lm, mixing, packing, quality, quality_rules, repair, secret_scan, sharding, simhash, warc
from .common import table

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[name] = functools.wraps(build)(lambda spark, sf_dir: build(prepare(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@query("op1_mix_to_weights")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a low-discrepancy mix takes of every document."""
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


@query("op2_simhash_trie")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash component of every document."""
    return simhash.components(table(spark, sf_dir, "documents"))


@query("op3_quality_trees")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_sorted_projections")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_shard_bytes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 contiguous shards of near equal bytes."""
    return sharding.shard_bytes(table(spark, sf_dir, "documents"))


@query("op6_log_bilinear")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return lm.scores(table(spark, sf_dir, "documents"))


@query("op7_revisits", warc.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified revisits of a crawl of all pages."""
    return warc.resolved_pages(table(spark, sf_dir, "pages"))


@query("op8_winnowing", decontamination.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_token_efficiency")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    import public_tokenizers
    return secret_scan.secret_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op10_packed_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written in packed files and read back."""
    import public_tokenizers
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query("op11_cover_tree_codes", cover_tree.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors under codebooks trained on all of them."""
    return cover_tree.compressed(table(spark, sf_dir, "embeddings"))


@query("op12_lightest_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    return repair.repair_summaries(repair.damaged(table(spark, sf_dir, "conversations")))


@query("op13_threshold_table", quality_rules.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the quality rules on every document."""
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))
