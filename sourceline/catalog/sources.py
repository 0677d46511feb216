"""Scans, sinks and keyed stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..session import work_dir
from ..sources import stores
from ..sources import tables as t
from . import sql as q
from .registry import query


def _path(spark, name):
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _chunk_rows(spark, sf_dir):
    return t.chunks(spark, sf_dir).select("deck_id", "id", F.concat("deck_id", F.lit(".pdf")).alias("source"), "page", "text", "n_chars",
                                          F.lit(None).cast("string").alias("origin"))


@query("s1_chunk_scan", q.with_views("select id, page, n_chars, md5(text) as digest from chunks", "chunks"))
def chunk_scan(spark, sf_dir):
    path = _path(spark, "chunks-json")
    _chunk_rows(spark, sf_dir).write.json(path)
    return stores.read_chunks(spark, path).select("id", "page", "n_chars", F.md5("text").alias("digest"))


def _log_lines(spark, sf_dir):
    """The log as JSON lines, with broken and blank lines among them."""
    log = t.question_log(spark, sf_dir)
    line = F.to_json(F.struct("at", "session", "question", "q_chars", "qtype", "status", "latency_ms"))
    return log.select(F.when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"broken": '), "question")).when(
        F.col("event_id") % 13 == 0, F.lit("  ")).otherwise(line).alias("value"))


@query("s2_log_scan", q.with_views("select question, q_chars, status, latency_ms from qlog where event_id % 11 <> 0 and event_id % 13 <> 0", "qlog"))
def log_scan(spark, sf_dir):
    path = _path(spark, "log-text")
    _log_lines(spark, sf_dir).write.text(path)
    return stores.read_log(spark, path).select("question", "q_chars", "status", "latency_ms")


@query("s2_missing_log", q.with_views("select session, status, count(*) as n, 0 as n_gone from qlog group by 1, 2", "qlog"))
def missing_log(spark, sf_dir):
    """A log that is there and one that is not, read as one: the missing one adds no rows and fits its columns."""
    log, gone = t.question_log(spark, sf_dir), stores.read_log(spark, _path(spark, "nowhere"))
    both = log.select("session", "status", F.lit(0).alias("gone")).unionByName(gone.select("session", "status", F.lit(1).alias("gone")))
    return both.groupBy("session", "status").agg(F.count("*").alias("n"), F.sum("gone").cast("int").alias("n_gone"))


@query("s3_gold_resolution", q.with_views("""
    select distinct qid, id from (select q.qid, c.id from conv_q q join chunks c on c.deck_id = q.deck_id where q.qid % 5 = 0 and c.page in (1, 2)
    union all select q.qid, c.id from conv_q q join chunks c on c.deck_id = q.deck_id where q.qid % 5 = 1 and c.page = 3
    union all select q.qid, c.id from conv_q q join chunks c on c.deck_id = q.deck_id where q.qid % 5 = 2 and c.page in (4, 5)
    union all select q.qid, c.id from conv_q q join chunks c on c.deck_id = q.deck_id where q.qid % 5 = 3 and c.page = 6)""", "conv_q", "chunks"))
def gold_resolution(spark, sf_dir):
    named = lambda p: F.concat("deck_id", F.lit(f"#p{p}"))
    which = F.col("qid") % 5
    asked = t.live_questions(spark, sf_dir).select(
        "qid", "deck_id", F.when(which == 0, F.array(named(1), named(2), F.lit("gone#p1"))).alias("gold_ids"), F.when(which.isin(0, 1), named(3)).alias("gold_id"),
        F.when(which == 2, F.array(F.lit(4), F.lit(5), F.lit(99999))).alias("gold_pages"), F.when(which.isin(2, 3), 6).when(which == 4, 99999).alias("gold_page"))
    return ev.resolve_gold(asked, t.chunks(spark, sf_dir))


@query("s4_chunk_write", q.with_views("select id, case when deck_id = 'src3' then 'new' else md5(text) end as digest from chunks", "chunks"))
def chunk_write(spark, sf_dir):
    """Write all decks, then one deck again: only that one changes."""
    path, rows = _path(spark, "chunks"), _chunk_rows(spark, sf_dir)
    stores.write_chunks(rows, path, 2)
    stores.write_chunks(rows.where(F.col("deck_id") == "src3").withColumn("text", F.lit("new")), path)
    return spark.read.parquet(path).select("id", F.when(F.col("deck_id") == "src3", F.col("text")).otherwise(F.md5("text")).alias("digest"))


@query("s5_log_append", q.with_views("select question, status from qlog where event_id % 2 = 0 union all select question, status from qlog where event_id % 2 = 1", "qlog"))
def log_append(spark, sf_dir):
    path, log = _path(spark, "log"), t.question_log(spark, sf_dir)
    for part in (0, 1):
        stores.append_log(log.where(F.col("event_id") % 2 == part).drop("event_id", "matched"), path)
    return stores.read_log(spark, path).select("question", "status")


@query("s6_deck_catalogue")
def deck_catalogue(spark, sf_dir):
    files = stores.file_catalogue(spark, sf_dir, ".parquet")
    docs = t.documents(spark, sf_dir)
    titles = docs.groupBy().agg(F.lit("documents").alias("deck_id"), F.lit("All documents").alias("title")).select("deck_id", "title")
    return stores.deck_catalogue(files, titles, titles).select("deck_id", "filename", "size_mb", "title", "ready")


def _own_titles(spark, sf_dir):
    return t.documents(spark, sf_dir).select("deck_id").distinct().where(F.col("deck_id").isin("src1", "src2", "src3")).withColumn(
        "title", F.concat(F.lit("Own "), "deck_id"))


@query("s7_deck_titles", q.with_views(f"""select deck_id, case when deck_id in ('src1', 'src2', 'src3') then 'Own ' || deck_id else coalesce(substr(
    (list_filter({q.lines('text')}, lambda l: length(l) >= 2))[1], 1, 40), '제목 없는 발표') end as title from chunks where page = 1""", "chunks"))
def deck_titles(spark, sf_dir):
    return stores.deck_titles(t.chunks(spark, sf_dir), _own_titles(spark, sf_dir))


@query("s8_rename", """with d as (select source as deck_id, count(*) as n, min(doc_id) as first from documents group by 1)
    select deck_id, case when first % 3 = 0 then trim(substr('Renamed ' || deck_id || ' ' || repeat('x', cast(n as integer)), 1, 60)) else 'Own ' || deck_id end as title
    from d where first % 3 = 0 or (first % 3 = 2 and first % 2 = 0)""")
def rename(spark, sf_dir):
    """All decks: a third gets a new title (cut at its limit), a third an empty one, the rest keep what they have."""
    decks = t.documents(spark, sf_dir).groupBy("deck_id").agg(F.count("*").cast("int").alias("n"), F.min("id").alias("first"))
    own = decks.where(F.col("first") % 2 == 0).select("deck_id", F.concat(F.lit("Own "), "deck_id").alias("title"))
    new = F.concat(F.lit("  Renamed "), F.col("deck_id"), F.lit(" "), F.repeat(F.lit("x"), F.col("n")))
    asked = decks.where(F.col("first") % 3 < 2).select("deck_id", F.when(F.col("first") % 3 == 0, new).otherwise("   ").alias("title"))
    return stores.rename_decks(own, asked)


@query("s9_delete_decks", q.with_views("select deck_id, count(*) as n from chunks where deck_id not in ('src1', 'src2') group by 1", "chunks"))
def delete_decks(spark, sf_dir):
    gone = t.documents(spark, sf_dir).select("deck_id").where(F.col("deck_id").isin("src1", "src2")).distinct()
    left = stores.delete_decks({"chunks": t.documents(spark, sf_dir), "titles": _own_titles(spark, sf_dir)}, gone)
    return left["chunks"].groupBy("deck_id").agg(F.count("*").alias("n"))


@query("s10_text_notes", q.with_views("select conv_id, md5(text) as digest from conversations"))
def text_notes(spark, sf_dir):
    """Both encodings decode to the same text."""
    return t.table(spark, sf_dir, "conversations").select("conv_id", F.md5(stores.decode_text(F.encode("text", "UTF-8"))).alias("digest"))


@query("s11_keyed_upsert", q.with_views("select id, case when ord % 2 = 0 then 'changed' else md5(text) end as digest from notes", "notes"))
def keyed_upsert(spark, sf_dir):
    notes = t.notes(spark, sf_dir).withColumn("digest", F.md5("text")).select("deck_id", "id", "ord", "digest")
    path = _path(spark, "notes")
    stores.write_keyed(notes, path)
    changed = notes.where(F.col("ord") % 2 == 0).withColumn("digest", F.lit("changed"))
    return stores.upsert(spark.read.parquet(path), changed, ["deck_id", "id"]).select("id", "digest")
