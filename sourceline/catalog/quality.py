"""Quality gate and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.profiles import LATIN
from ..operators import quality as ql
from ..sources import tables as t
from . import sql as q
from .registry import query

# the test texts have at most 26 or so letters, so the most frequent one often has a high share
GRADED = r"""
    g as (select *, letters < 20 or garbled as dead from (select c.*, len(ch) as letters,
        len(ch) >= 15 and list_max(list_transform(list_distinct(ch), lambda x: len(list_filter(ch, lambda y: y = x)))) / len(ch) > 0.25 as garbled
        from (select *, regexp_extract_all(text, '\p{L}') as ch from chunks) c))"""


def _graded(spark, sf_dir):
    return ql.grade_pages(t.chunks(spark, sf_dir), LATIN)


@query("q1_letter_count", r"select doc_id as id, len(regexp_extract_all(text, '[가-힣A-Za-z]')) as letters from documents")
def letters(spark, sf_dir):
    from ..functions.text import letter_count
    return t.documents(spark, sf_dir).select("id", letter_count(F.col("text")).alias("letters"))


@query("q2_garbled_pages", q.with_views(f"with {GRADED} select doc_id, garbled from g", "chunks"))
def garbled(spark, sf_dir):
    return _graded(spark, sf_dir).select("doc_id", "garbled")


@query("q3_page_grades", q.with_views(f"""with {GRADED} select deck_id, page, letters, dead,
    regexp_matches(text, '^[\\s•\\-\\*■]+$') as glyph_only,
    regexp_matches(text, '[•]') and letters < 60 as bullet_no_body from g""", "chunks"))
def page_grades(spark, sf_dir):
    return _graded(spark, sf_dir).select("deck_id", "page", "letters", "dead", "glyph_only", "bullet_no_body")


@query("q4_deck_verdicts", q.with_views(f"""with {GRADED}
    select deck_id, count(*) as total, count_if(dead) as n_dead, median(letters) as median_letters,
        round(count_if(dead) / count(*), 3) as dead_ratio, case when count_if(dead) / count(*) > 0.15 then 'fail'
        when count_if(dead) / count(*) > 0.05 then 'warn' else 'good' end as verdict from g group by 1""", "chunks"))
def verdicts(spark, sf_dir):
    return ql.deck_verdicts(_graded(spark, sf_dir))


@query("q4_dead_pages", q.with_views(f"with {GRADED} select deck_id, page from g where dead", "chunks"))
def dead_pages(spark, sf_dir):
    return ql.dead_pages(_graded(spark, sf_dir))


@query("q5_length_profile", q.with_views("""
    select deck_id, min(n_chars) as shortest, max(n_chars) as longest, count_if(n_chars < 30) as n_thin,
        list_sort(list(n_chars))[count(*) // 2 + 1] as middle from docs group by 1""", "docs"))
def length_profile(spark, sf_dir):
    return ql.length_profile(t.documents(spark, sf_dir))


def _needed(spark, sf_dir):
    """Pages of the web table stand in for page images of the decks' pages."""
    chunks = t.chunks(spark, sf_dir)
    images = t.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html"))
    return chunks.join(images, "doc_id").select("deck_id", "page", ql.read_key(
        F.col("html"), "reader", "small", "read this").alias("key"), "doc_id")


NEEDED = """need as (select c.deck_id, c.page, sha256(p.html || 'reader|small|read this') as key, c.doc_id
    from chunks c join pages p on c.doc_id = p.page_id)"""


@query("q6_reread_plan", q.with_views(f"""with {NEEDED}, cached as (select key from need where doc_id % 5 = 0),
    todo as (select *, row_number() over (partition by deck_id order by page) as n from need where key not in (select key from cached))
    select deck_id, page, 'cached' as action from need where key in (select key from cached)
    union all select deck_id, page, case when n <= 3 then 'read' else 'over_limit' end from todo""", "chunks"))
def reread_plan(spark, sf_dir):
    needed = _needed(spark, sf_dir)
    cached = needed.where(F.col("doc_id") % 5 == 0).select("key")
    return ql.reread_plan(needed.drop("doc_id"), cached, 3).select("deck_id", "page", "action")


@query("q6_unusable_pages", q.with_views(f"with {GRADED} select deck_id, page from g where dead", "chunks"))
def unusable(spark, sf_dir):
    return ql.unusable_pages(t.chunks(spark, sf_dir), LATIN).select("deck_id", "page")


def _merged(spark, sf_dir):
    pages = t.chunks(spark, sf_dir).where(F.col("page") % 7 != 0).select(
        "deck_id", "page", F.concat("text", F.lit("\n\n[노트] said "), F.col("page").cast("string")).alias("text"))
    recovered = t.chunks(spark, sf_dir).where(F.col("page") % 2 == 0).select(
        "deck_id", "page", F.when(F.col("page") % 4 == 0, F.concat(F.lit("recovered "), "id")).alias("text"))
    return ql.merge_recovered(pages, recovered)


MERGED = """m as (select c.deck_id, c.page, c.page % 2 = 0 and c.page % 4 <> 0 as failed,
    case when c.page % 4 = 0 then 'caption' end as origin,
    case when c.page % 4 = 0 then 'recovered ' || c.id || case when c.page % 7 <> 0 then chr(10) || chr(10) || '[노트] said ' || c.page else '' end
         when c.page % 7 <> 0 then c.text || chr(10) || chr(10) || '[노트] said ' || c.page end as text
    from chunks c where c.page % 7 <> 0 or c.page % 2 = 0)"""


@query("q7_merge_recovered", q.with_views(f"with {MERGED} select deck_id, page, failed, origin, length(text) as n_chars, md5(text) as digest from m", "chunks"))
def merge_recovered(spark, sf_dir):
    return _merged(spark, sf_dir).select("deck_id", "page", "failed", "origin", "n_chars", F.md5("text").alias("digest"))


@query("q7_merge_summary", q.with_views(f"""with {MERGED}
    select deck_id, count(*) as total, count(origin) as n_recovered, count_if(failed) as n_failed,
        case when count(origin) = 0 then 'text' when count(origin) = count(*) then 'image' else 'mixed' end as method,
        case when count_if(failed) > 0 then case when bool_or(failed and page % 6 = 0) then 'call_limit' else 'caption_error' end end as reason
    from m group by 1""", "chunks"))
def merge_summary(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    failures = merged.where("failed").select("deck_id", "page", F.when(
        F.col("page") % 6 == 0, "call_limit").otherwise("caption_error").alias("reason"))
    return ql.merge_summary(merged, failures)
