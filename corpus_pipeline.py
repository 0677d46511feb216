"""A training corpus from ``documents``: quality, near-duplicates, benchmark passages, mix, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourceline.llm import decontamination, mixing, near_copies, quality, sharding
from sourceline.llm.common import table
from sourceline.plans.materialize import stored
from sourceline.session import prepare


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labels, does not reject."""
    return quality.accepted(docs, table(prepare(spark), sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every component of near copies: five words, Jaccard 0.8.

    Fingerprints linked by SimHash tries are checked first; the links that they miss are found after them.
    """
    prepare(spark)
    return near_copies.one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark contaminates."""
    return decontamination.clean_documents(docs, table(prepare(spark), sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources begins them; a copy is a row of its own."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of near equal bytes and their slot in it."""
    prepare(spark)
    return sharding.sharded_documents(docs)


STAGES = [("quality_trees", good_documents), ("simhash_trie", distinct_documents), ("winnowing", clean_documents),
          ("mix_to_weights", mixed_documents), ("shard_bytes", sharded_documents)]

#: The classifier is beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
