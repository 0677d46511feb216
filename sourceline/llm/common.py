"""Columns and helpers that several training-data operators share."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

#: A word: a run of anything but ASCII white space (the characters that ``bytes.split()`` splits at).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(docs: DataFrame) -> DataFrame:
    """``row``, a number for each row, and ``doc``, its columns: no column of ``docs`` can meet a name of ours."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


KEY = ["key_null", "key_id", "key_text"]


def keyed(docs: DataFrame) -> DataFrame:
    """``KEY``, ``doc``: documents under a key of id and text, the same in every reading of a table.

    Rows with one id and one text share a key.
    """
    return docs.select(F.col("doc_id").isNull().alias(KEY[0]), F.coalesce("doc_id", F.lit(0)).alias(KEY[1]),
                       F.coalesce(F.xxhash64("text"), F.lit(0)).alias(KEY[2]), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is.

    ``lower`` does just that on pure ASCII, and fast; other texts are translated.
    """
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def united(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parent`` (of every node, its smallest known companion) after linking each i with its j."""
    while True:
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return parent
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def crc_of_id(ident: object) -> int:
    """Unsigned crc32 of an id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if ident is None or ident != ident else str(int(ident)).encode())


def fold_column(ident: Column) -> Column:
    """The same value as a Column."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))
