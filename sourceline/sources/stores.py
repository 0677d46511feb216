"""Reading and writing: chunks, logs, keyed per-deck tables, file catalogues."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_long_line
from ..plans.ranking import first_per_group

CHUNK = T.StructType([
    T.StructField("deck_id", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("n_chars", T.IntegerType()),
    T.StructField("origin", T.StringType())])

LOG = T.StructType([
    T.StructField("at", T.TimestampType()), T.StructField("session", T.StringType()),
    T.StructField("question", T.StringType()), T.StructField("q_chars", T.IntegerType()),
    T.StructField("qtype", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()), T.StructField("slides", T.ArrayType(T.IntegerType())),
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("weak_type", T.BooleanType()),
    T.StructField("expected_hit", T.StructType([
        T.StructField("matched", T.BooleanType()), T.StructField("same_slide", T.BooleanType()),
        T.StructField("slide", T.IntegerType()), T.StructField("text_overlap", T.DoubleType()),
        T.StructField("closest_expected", T.StringType())]))])

NOTE = T.StructType([
    T.StructField("deck_id", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("page", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("created", T.TimestampType()), T.StructField("para", T.IntegerType()),
    T.StructField("section", T.StringType()), T.StructField("ord", T.LongType())])

# ---- fixed values -------------------------------------------------------------------
DEFAULT_TITLE = "제목 없는 발표"
TITLE_MAX = 60
# -------------------------------------------------------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, so it works for object stores as well."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk JSON lines, one object per line."""
    return spark.read.schema(CHUNK).json(path)


def write_chunks(chunks: DataFrame, path: str, files_per_deck: int = 1) -> None:
    """One folder per deck; writing some decks replaces just those. A big deck is spread over
    ``files_per_deck`` tasks."""
    salt = F.pmod(F.hash("id"), F.lit(files_per_deck))
    (chunks.repartition("deck_id", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("deck_id").parquet(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A question log that may be missing, with blank or broken lines: those are skipped."""
    if not path_exists(spark, path):
        return empty(spark, LOG)
    fields = T.StructType([*LOG.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(fields).option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where(F.col("_broken").isNull()).drop("_broken")


def append_log(rows: DataFrame, path: str) -> bool:
    """Append; a failed write is reported by the return value, never raised into the caller."""
    try:
        rows.write.mode("append").json(path)
        return True
    except Exception:
        return False


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A per-deck table; a missing table counts as empty, and so does an unreadable file of one.

    Reading is lazy, so files are skipped when they are read: a broken footer or page costs that
    file's rows, not the job.
    """
    if not path_exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows with changed ones in their place and new ones added."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_per_group(both, list(keys), [F.col("_new").desc()]).drop("_new")


def delete_keys(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(gone.select(*keys), list(keys), "left_anti")


def write_keyed(rows: DataFrame, path: str) -> None:
    """Replace the decks that occur in ``rows``; the others stay."""
    (rows.repartition("deck_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("deck_id").parquet(path))


def rename_decks(titles: DataFrame, requests: DataFrame) -> DataFrame:
    """Titles (``deck_id, title``) after rename requests; an empty title removes the name."""
    asked = requests.select("deck_id", F.substring(F.trim(F.coalesce("title", F.lit(""))), 1, TITLE_MAX).alias("title"))
    return upsert(titles, asked, ["deck_id"]).where(F.col("title") != "")


def delete_decks(stored: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table keyed by deck, without the deleted decks."""
    return {name: delete_keys(table, gone, ["deck_id"]) for name, table in stored.items()}


def deck_titles(chunks: DataFrame, titles: DataFrame, default: str = DEFAULT_TITLE) -> DataFrame:
    """A deck's own title, else the first line of its first chunk that has two characters,
    else a default."""
    first = chunks.groupBy("deck_id").agg(F.min_by("text", "page").alias("_text"))
    named = titles.select("deck_id", F.col("title").alias("_own"))
    return first.join(named, "deck_id", "full_outer").select("deck_id", F.coalesce(
        F.when(F.col("_own") != "", F.col("_own")), first_long_line(F.coalesce("_text", F.lit(""))), F.lit(default)).alias("title"))


def file_catalogue(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """``deck_id, filename, size_mb, uploaded_at``; file contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
             .select("path", "modificationTime", "length"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.expr(f"left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - {len(suffix)})").alias("deck_id"),
                        name.alias("filename"), F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
                        F.col("modificationTime").alias("uploaded_at"))


def deck_catalogue(files: DataFrame, titles: DataFrame, ready: DataFrame, default: str = DEFAULT_TITLE) -> DataFrame:
    """Files with title and readiness, newest first."""
    return (files.join(titles, "deck_id", "left").join(ready.select("deck_id", F.lit(True).alias("ready")).distinct(), "deck_id", "left")
            .withColumn("title", F.coalesce("title", F.lit(default))).withColumn("ready", F.coalesce("ready", F.lit(False)))
            .orderBy(F.col("uploaded_at").desc()))


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """UTF-8 (with or without mark), else CP949, else null."""
    def one(raw: bytes | None) -> str | None:
        for encoding in ("utf-8-sig", "cp949"):
            try:
                return None if raw is None else bytes(raw).decode(encoding)
            except UnicodeDecodeError:
                continue
        return None
    return content.map(one)


def read_text_notes(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """``path, text`` of text files in either encoding."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", decode_text("content").alias("text"))


def assemble_chunks(pages: DataFrame, extension: str = ".pdf") -> DataFrame:
    """Chunk rows from ``deck_id, page, body, notes``: id, source and length follow."""
    from ..functions.text import with_notes
    return (pages.withColumn("text", with_notes(F.col("body"), F.col("notes")))
            .withColumn("id", chunk_id(F.col("deck_id"), F.col("page")))
            .withColumn("source", F.concat("deck_id", F.lit(extension)))
            .withColumn("n_chars", F.length("text")).drop("body", "notes"))


def chunk_id(deck_id: Column, page: Column) -> Column:
    return F.concat(deck_id, F.lit("#p"), page.cast("string"))
