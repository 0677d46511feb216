"""Views over the star-schema tables that stand in for decks, questions, notes and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_lines
from ..plans.ranking import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without page numbers: no shuffle."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("deck_id"), "text",
        F.length("text").alias("n_chars"))


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deck_id, doc_id, page``; pages number a deck's documents by id."""
    return number_rows(table(spark, sf_dir, "documents").select(F.col("source").alias("deck_id"), "doc_id"), ["deck_id"], "doc_id", "page")


def chunks(spark: SparkSession, sf_dir: str, numbers: DataFrame | None = None) -> DataFrame:
    """``deck_id, page, id, doc_id, text, n_chars``; ``numbers`` are the :func:`page_numbers`, if written before."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("deck_id"), "doc_id", "text", F.length("text").alias("n_chars"))
    pages = page_numbers(spark, sf_dir) if numbers is None else numbers
    return (docs.join(pages, ["deck_id", "doc_id"])
            .withColumn("id", F.concat("deck_id", F.lit("#p"), F.col("page").cast("string"))))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def live_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions, each asked of one deck."""
    turns = table(spark, sf_dir, "conversations")
    return turns.where(F.col("role") == "user").select(
        (F.col("conv_id") * 16777216 + F.col("turn")).alias("qid"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("deck_id"),
        "conv_id", "turn", F.col("text").alias("question"))


def spoken_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn with the assistant turn right after it: ``qid, deck_id, page, question, answer``."""
    turns = table(spark, sf_dir, "conversations")
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return live_questions(spark, sf_dir).join(reply, ["conv_id", "turn"]).withColumn(
        "page", (F.col("conv_id") % 10 + 1).cast("int"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation lines as speaker explanations: ``deck_id, id, page, kind, text, source, para, section, ord``."""
    turns = table(spark, sf_dir, "conversations")
    lines = turns.select(
        F.col("conv_id").alias("deck_id"), F.col("turn").alias("para"), "role",
        F.posexplode(split_lines(F.col("text"))).alias("line_no", "text"))
    ordinal = (F.col("para") * 16777216 + F.col("line_no")).alias("ord")
    kind = (F.when(F.col("line_no") % 4 == 3, "repeat").when(F.col("line_no") % 4 == 1, "fact").otherwise("explain"))
    page = F.when((F.col("para") + F.col("line_no")) % 5 != 0, ((F.col("para") + F.col("line_no")) % 5).cast("int"))
    return lines.select(
        "deck_id", F.concat_ws("-", F.col("deck_id").cast("string"), F.col("para").cast("string"),
                               F.col("line_no").cast("string")).alias("id"),
        page.alias("page"), kind.alias("kind"), "text",
        F.when(F.col("role") == "user", "rehearsal").otherwise("script").alias("source"),
        F.when(F.col("role") != "user", F.col("para").cast("int")).alias("para"),
        F.when(F.col("role") != "user", F.concat(F.lit("Part "), F.col("para").cast("string"))).alias("section"),
        ordinal)


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a question log."""
    events = table(spark, sf_dir, "events")
    chars = F.get_json_object("props", "$.k").cast("int")
    status = (F.when(F.col("event_type") == "error", "no_evidence")
              .when(F.col("event_type") == "signup", "ignored").otherwise("ok"))
    return events.select(
        "event_id", F.col("ts").alias("at"), F.col("user_id").cast("string").alias("session"),
        F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("question"),
        chars.alias("q_chars"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("qtype"),
        status.alias("status"), F.col("value").alias("latency_ms"),
        F.when(chars % 3 != 0, chars % 2 == 0).alias("matched"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a relation graph: ``src, dst, relation, why, ord``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"),
        F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("why"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("ord"))


def gold_pairs(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents that contain a whole question: ``qid, id``.

    The inner words of a question stand whole in any such document, so the longest of them
    is an equi-join key and only matching pairs are compared. A question of fewer than three words
    has no inner word, as its words may be parts of longer ones: it meets every document.
    """
    needle = F.col("question")
    found = F.regexp_extract_all(needle, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    inner = F.slice(found, 2, F.size(found) - 2)
    by_length = F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    keyed = queries.where(F.size(found) >= 3).select(
        "qid", needle.alias("needle"), F.get(by_length, F.lit(0))["w"].alias("word"))
    words = docs.select(F.col("id").alias("_id"), F.explode_outer(F.array_distinct(
        F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    candidates = words.join(keyed, "word").select("_id", "qid", "needle")
    holds = F.contains("text", "needle")
    long = docs.select("id", "text").join(candidates, F.col("id").eqNullSafe(F.col("_id"))).where(holds)
    short = queries.where(F.size(found) < 3).select("qid", needle.alias("needle"))
    return long.select("qid", "id").unionByName(docs.select("id", "text").join(short, holds).select("qid", "id"))
