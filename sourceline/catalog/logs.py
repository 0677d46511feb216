"""Question-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as lg
from ..operators import practice as pr
from ..sources import tables as t
from . import sql as q
from .registry import query

SUMMARY = """select session, count(*) as total, count_if(status = 'ok') as answered, count_if(status = 'no_evidence') as no_evidence,
    count_if(status = 'ignored') as ignored, round(avg(case when status = 'ok' then latency_ms end), 1) as avg_latency_ms,
    max("at") as last_at from qlog group by session"""


@query("l1_session_summary", q.with_views(SUMMARY, "qlog"))
def session_summary(spark, sf_dir):
    return lg.newest_first(lg.session_summary(t.question_log(spark, sf_dir)))


@query("l2_session_log", q.with_views("""select event_id, "at", question, status, qtype from qlog where session = '7'""", "qlog"))
def session_log(spark, sf_dir):
    return lg.session_log(t.question_log(spark, sf_dir), "7").select("event_id", "at", "question", "status", "qtype")


@query("l3_deck_summary", q.with_views(f"""select s.*, j.judged as expected_judged,
    case when judged > 0 then round(100 * hits / judged, 1) end as expected_hit_rate from ({SUMMARY}) s
    join (select session, count(matched) as judged, count_if(matched) as hits from qlog group by 1) j using (session)""", "qlog"))
def deck_summary(spark, sf_dir):
    return lg.deck_summary(t.question_log(spark, sf_dir))


@query("l3_type_distribution", q.with_views("select session, coalesce(qtype, '미분류') as qtype, count(*) as n from qlog group by 1, 2", "qlog"))
def type_distribution(spark, sf_dir):
    return lg.type_distribution(t.question_log(spark, sf_dir))


@query("l4_global_stats", q.with_views("""
    select 'total' as metric, '' as label, count(*) as n from qlog union all select 'status', status, count(*) from qlog group by status
    union all select 'qtype', qtype, count(*) from qlog where qtype is not null group by qtype
    union all select 'judged', '', count(matched) from qlog union all select 'hits', '', count_if(matched) from qlog""", "qlog"))
def global_stats(spark, sf_dir):
    return lg.global_stats(t.question_log(spark, sf_dir))


@query("l4_ordered_values", q.with_views("""
    select metric, row_number() over (partition by metric order by value) as place, value from (
        select 'q_chars' as metric, cast(q_chars as double) as value from qlog where q_chars is not null
        union all select 'latency_ms', latency_ms from qlog where status = 'ok' and latency_ms is not null)""", "qlog"))
def ordered_values(spark, sf_dir):
    return lg.ordered_values(t.question_log(spark, sf_dir))


@query("l5_report", q.with_views("""
    with f as (select count(*) as total, count_if(status = 'ok') as ok, count_if(status = 'no_evidence') as ne, count_if(status = 'ignored') as ig,
        count_if(q_chars >= 60) as n_long, count(matched) as judged, count_if(matched) as hits, median(q_chars) as med, max(q_chars) as longest from qlog),
    l as (select list_sort(list(latency_ms)) as ls, count(*) as n from qlog where status = 'ok')
    select 'status' as section, 'ok' as label, cast(ok as double) as value, round(ok / total, 6) as share, null as verdict from f
    union all select 'status', 'no_evidence', ne, round(ne / total, 6), case when ne / total > 0.3 then 'too many' else 'fine' end from f
    union all select 'status', 'ignored', ig, round(ig / total, 6), null from f
    union all select 'length', 'long questions', n_long, round(n_long / total, 6), case when n_long / total < 0.2 then 'short enough' else 'summaries may help' end from f
    union all select 'expected', 'hits', hits, round(hits / judged, 6), case when judged = 0 then 'no record' end from f
    union all select 'length', 'median', med, null, null from f union all select 'length', 'longest', longest, null, null from f
    union all select 'latency', 'p50', ls[n // 2 + 1], null, null from l
    union all select 'latency', 'p95', ls[least(n - 1, cast(floor(n * 0.95) as bigint)) + 1], null,
        case when ls[least(n - 1, cast(floor(n * 0.95) as bigint)) + 1] > 1000 then 'over budget' else 'within budget' end from l
    union all select 'type', qtype, count(*), round(count(*) / sum(count(*)) over (), 6), null from qlog where qtype is not null group by qtype""", "qlog"))
def report(spark, sf_dir):
    return lg.report(t.question_log(spark, sf_dir))


@query("l5_first_missed", q.with_views("""select event_id, question from qlog where not matched order by "at", question limit 5""", "qlog"))
def first_missed(spark, sf_dir):
    return lg.first_missed(t.question_log(spark, sf_dir)).select("event_id", "question")


def _expected(spark, sf_dir):
    """A practice set: the first two assistant turns per deck and type, as questions."""
    turns = t.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    made = turns.select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("deck_id"),
        F.concat(F.lit("type"), (F.col("turn") % 4).cast("string")).alias("qtype"),
        (F.col("conv_id") * 16777216 + F.col("turn")).alias("ord"), F.col("text").alias("question"),
        (F.col("conv_id") % 9 + 1).cast("int").alias("page"))
    return pr.practice_set(made, 2)


EXPECTED = """expected as (select * from (select *, cast(row_number() over (partition by deck_id, qtype order by ord) as integer) as place from (
    select 'src' || (conv_id % 20) as deck_id, 'type' || (turn % 4) as qtype, conv_id * 16777216 + turn as ord, text as question,
        cast(conv_id % 9 + 1 as integer) as page from conversations where role = 'assistant')) where place <= 2)"""


@query("p8_practice_set", f"with {EXPECTED} select deck_id, qtype, place, ord, page from expected")
def practice_set(spark, sf_dir):
    return _expected(spark, sf_dir).select("deck_id", "qtype", "place", "ord", "page")


@query("p8_gold_ids", q.with_views(f"with {EXPECTED} select e.deck_id, e.qtype, e.place, c.id as gold_id from expected e left join chunks c on c.deck_id = e.deck_id and c.page = e.page", "chunks"))
def gold_ids(spark, sf_dir):
    return pr.attach_gold(_expected(spark, sf_dir), t.chunks(spark, sf_dir)).select("deck_id", "qtype", "place", "gold_id")


HIT_WORDS = "list_distinct(regexp_extract_all({0}, '[가-힣]{{2,}}|[A-Za-z]{{2,}}|[0-9][0-9,.]*'))"


@query("l6_expected_hits", q.with_views(f"""
    with {EXPECTED},
    a as (select *, case when qid % 4 <> 0 then cast(qid % 9 + 1 as integer) end as slide, {HIT_WORDS.format('question')} as ws from conv_q),
    pairs as (select a.qid, e.ord, e.question, e.page, a.slide, len(list_intersect(a.ws, {HIT_WORDS.format('e.question')}))
        / least(len(a.ws), len({HIT_WORDS.format('e.question')})) as score from a join expected e using (deck_id)
        where len(a.ws) > 0 and len({HIT_WORDS.format('e.question')}) > 0),
    best as (select * from (select *, row_number() over (partition by qid order by score desc, ord) as r from pairs) where r = 1)
    select a.qid, case when len(a.ws) > 0 and a.slide is not null then exists (select 1 from expected e where e.deck_id = a.deck_id and e.page = a.slide) end as matched,
        case when len(a.ws) > 0 and a.slide is not null then round(coalesce(b.score, 0), 3) end as text_overlap,
        case when len(a.ws) > 0 and a.slide is not null then case when b.score > 0 then substr(b.question, 1, 60) else '' end end as closest_expected
    from a left join best b using (qid)""", "conv_q"))
def expected_hits(spark, sf_dir):
    asked = t.live_questions(spark, sf_dir).withColumn("slide", F.when(F.col("qid") % 4 != 0, (F.col("qid") % 9 + 1).cast("int")))
    expected = _expected(spark, sf_dir).withColumn("gold_page", F.lit(None).cast("int"))
    return lg.expected_hits(asked, expected).select("qid", "matched", "text_overlap", "closest_expected")


def _titles(spark, sf_dir):
    return t.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == 0).select(
        F.col("c_custkey").cast("string").alias("session"), F.col("c_name").alias("title"))


@query("l7_portfolio", q.with_views(f"""select s.session, s.total, coalesce(c.c_name, '지워진 발표') as title from ({SUMMARY}) s
    left join customer c on cast(c.c_custkey as varchar) = s.session and c.c_custkey % 3 = 0""", "qlog"))
def portfolio(spark, sf_dir):
    summary = lg.session_summary(t.question_log(spark, sf_dir))
    return lg.portfolio(summary, _titles(spark, sf_dir)).select("session", "total", "title")


@query("l7_portfolio_totals", q.with_views("select count(distinct session) as n_sessions, count(*) as total, count_if(status = 'ok') as answered from qlog", "qlog"))
def portfolio_totals(spark, sf_dir):
    return lg.portfolio_totals(lg.session_summary(t.question_log(spark, sf_dir)))


@query("l8_mix", q.with_views("""
    with s as (select session, count(*) as n_all, round(avg(case when status = 'ok' then latency_ms end)) as avg_latency_ms from qlog group by 1),
    r as (select session, 'status' as facet, status as label, count(*) as n from qlog group by 1, 3
          union all select session, 'type', coalesce(qtype, '미분류'), count(*) from qlog group by 1, 3)
    select r.*, cast(round(100 * n / n_all) as integer) as percent, avg_latency_ms from r join s using (session)""", "qlog"))
def mix(spark, sf_dir):
    return lg.mix(t.question_log(spark, sf_dir))
