"""Index-time tables of the test decks. A query builds those that it needs, once, as written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix
from ..plans.materialize import stored
from ..sources import tables as t


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all decks; ``id`` is the document id. Only their numbers are written: texts are read where they are used."""
    return t.chunks(spark, sf_dir, stored(t.page_numbers(spark, sf_dir), "page-numbers")).withColumn("id", F.col("doc_id"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(ix.vocabulary(t.documents(spark, sf_dir), scope=["deck_id"]), "vocabulary")


def index(spark: SparkSession, sf_dir: str) -> ix.Index:
    return ix.build_index(t.documents(spark, sf_dir), scope=["deck_id"])
