"""Evaluation of retrievers, classifiers and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import numbers_supported, numbers_supported_by_name
from ..operators import evaluate as ev
from ..operators import generated as gen
from ..operators import guards
from ..operators import index as ix
from ..operators import search as se
from ..functions.profiles import LATIN
from ..sources import tables as t
from . import sql as q
from .registry import query


def _hits(spark, sf_dir, k=5):
    return se.bm25_search(ix.build_index(t.documents(spark, sf_dir)), t.questions(spark, sf_dir), k)


def _gold(spark, sf_dir):
    return t.gold_pairs(t.documents(spark, sf_dir), t.questions(spark, sf_dir))


FIRST = """first as (select g.qid, min(h.rank) as rank from (select distinct qid from gold) g
    left join (select h.* from bm25_rank h join gold using (qid, id) where h.rank <= {depth}) h on h.qid = g.qid
    group by g.qid)"""
RECALL = """count(*) as n, round(avg(case when rank <= 1 then 1.0 else 0 end), 6) as recall_1,
    round(avg(case when rank <= 3 then 1.0 else 0 end), 6) as recall_3,
    round(avg(case when rank <= 5 then 1.0 else 0 end), 6) as recall_5,
    round(avg(coalesce(1.0 / rank, 0)), 6) as mrr"""


@query("v0_gold_pairs", q.with_views("select qid, id from gold", "gold"))
def gold(spark, sf_dir):
    return _gold(spark, sf_dir)


@query("v1_recall_and_mrr", q.with_views(f"with {FIRST.format(depth=5)} select {RECALL} from first", "gold", "bm25_rank"))
def recall(spark, sf_dir):
    return ev.recall_report(_hits(spark, sf_dir), _gold(spark, sf_dir))


def _swapped_gold(spark, sf_dir):
    """Gold shifted to the neighbouring question, so that misses exist."""
    return _gold(spark, sf_dir).withColumn("qid", F.col("qid") + 1).join(
        t.questions(spark, sf_dir).select("qid"), "qid", "left_semi")


@query("v2_misses", q.with_views("""
    with sg as (select g.qid + 1 as qid, g.id from gold g where g.qid + 1 in (select qid from bq)),
    fr as (select g.qid, min(h.rank) as rank from (select distinct qid from sg) g left join (
        select h.* from bm25_rank h join sg using (qid, id) where h.rank <= 5) h on h.qid = g.qid group by g.qid)
    select qid, cast(rank as integer) as rank from fr where rank is null or rank > 3""", "gold", "bm25_rank", "bq"))
def missed(spark, sf_dir):
    return ev.misses(_hits(spark, sf_dir), _swapped_gold(spark, sf_dir))


@query("v3_miss_diagnosis", q.with_views(f"""
    with sg as (select g.qid + 1 as qid, g.id from gold g where g.qid + 1 in (select qid from bq)),
    fr as (select g.qid, min(h.rank) as rank from (select distinct qid from sg) g left join (
        select h.* from bm25_rank h join sg using (qid, id) where h.rank <= 20) h on h.qid = g.qid group by g.qid),
    tgt as (select qid, min(id) as gold_id from sg group by 1)
    select fr.qid, tgt.gold_id, cast(fr.rank as integer) as gold_rank,
        array_to_string(list_slice(list_sort(list_distinct(list_intersect({q.tokens('b.question')}, {q.tokens('d.text')}))), 1, 12), ' ') as shared_terms,
        (select string_agg(h.id || ':' || replace(substr(x.text, 1, 90), chr(10), ' '), '|' order by h.rank)
         from bm25_rank h join docs x on x.id = h.id where h.qid = fr.qid and h.rank <= 3) as came
    from fr join tgt using (qid) join bq b on b.qid = fr.qid join docs d on d.id = tgt.gold_id
    where fr.rank is null or fr.rank > 3""", "gold", "bq", "bm25_rank", "docs"))
def miss_diagnosis(spark, sf_dir):
    found = ev.diagnose(_hits(spark, sf_dir, 20), _swapped_gold(spark, sf_dir), t.questions(spark, sf_dir),
                        t.documents(spark, sf_dir))
    return found.select("qid", "gold_id", "gold_rank", F.array_join("shared_terms", " ").alias("shared_terms"),
                        F.array_join(F.transform("came", lambda c: F.concat_ws(
                            ":", c["id"].cast("string"), c["preview"])), "|").alias("came"))


@query("v4_leaderboard", q.with_views(f"""
    with {FIRST.format(depth=5)},
    fused as (select qid, id, row_number() over (partition by qid order by s desc, lead, id) as rank from (
        select qid, id, round(sum(1 / (60.0 + rank)), 12) as s, min(case when l = 0 then rank end) as lead from (
            select qid, id, rank, 0 as l from bm25_rank where rank <= 5
            union all select qid, id, 6 - rank, 1 from bm25_rank where rank <= 5) group by qid, id)),
    ff as (select g.qid, min(h.rank) as rank from (select distinct qid from gold) g left join (
        select h.* from fused h join gold using (qid, id) where h.rank <= 5) h on h.qid = g.qid group by g.qid),
    fr as (select g.qid, min(6 - h.rank) as rank from (select distinct qid from gold) g left join (
        select h.* from bm25_rank h join gold using (qid, id) where h.rank <= 5) h on h.qid = g.qid group by g.qid)
    select *, cast(row_number() over (order by recall_3 desc, o) as integer) as place from (
        select 'bm25' as retriever, {RECALL} , 0 as o from first
        union all select 'backwards', {RECALL}, 1 from fr union all select 'fused', {RECALL}, 2 from ff)
    """.replace("select *, cast(row", "select * exclude (o), cast(row"), "gold", "bm25_rank"))
def retriever_leaderboard(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    backwards = hits.withColumn("rank", 6 - F.col("rank"))
    return ev.leaderboard({"bm25": hits, "backwards": backwards, "fused": se.fuse_hits(hits, backwards, 5)},
                          _gold(spark, sf_dir))


@query("v5_latency_percentiles", q.with_views("""
    select qtype, list_sort(list(latency_ms))[count(*) // 2 + 1] as p50,
        list_sort(list(latency_ms))[least(count(*) - 1, cast(floor(count(*) * 0.95) as bigint)) + 1] as p95
    from qlog where qtype is not null group by qtype""", "qlog"))
def latency_percentiles(spark, sf_dir):
    log = t.question_log(spark, sf_dir)
    return ev.latency_profile(log.where(F.col("qtype").isNotNull()), ["qtype"])


def _length_rule(spark, sf_dir):
    """A rule classifier: long documents are good ones."""
    docs = t.documents(spark, sf_dir)
    lab = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("actual"))
    return lab.join(docs.select("id", "n_chars"), "id").select(
        "actual", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("predicted"))


@query("v6_class_report", """
    with p as (select l.quality as actual, case when length(d.text) > 800 then 1 else 0 end as predicted
               from labels l join documents d using (doc_id)),
    a as (select actual as label, count(*) as n, count_if(actual = predicted) as hits from p group by 1),
    b as (select predicted as label, count(*) as n_predicted from p group by 1)
    select a.label, n, hits, coalesce(n_predicted, 0) as n_predicted, round(hits / n, 6) as recall,
        round(case when coalesce(n_predicted, 0) > 0 then hits / n_predicted else 0 end, 6) as precision,
        (select round(avg(case when actual = predicted then 1.0 else 0 end), 6) from p) as accuracy
    from a left join b using (label)""")
def class_report(spark, sf_dir):
    return ev.class_report(_length_rule(spark, sf_dir))


@query("v6_confusion", """
    select l.quality as actual, count_if(length(d.text) <= 800) as "0", count_if(length(d.text) > 800) as "1"
    from labels l join documents d using (doc_id) group by 1""")
def confusion(spark, sf_dir):
    return ev.confusion(_length_rule(spark, sf_dir), [0, 1])


@query("v7_best_of", """
    with s as (select
        (select max(n) / sum(n) from (select label, count(*) as n from embeddings group by 1)) as m,
        (select avg(case when l.quality = case when length(d.text) > 800 then 1 else 0 end then 1.0 else 0 end)
         from labels l join documents d using (doc_id)) as r,
        (select avg(case when label = vec_id % 3 then 1.0 else 0 end) from embeddings) as k)
    select case when m >= r and m >= k then 'majority' when r >= k then 'rules' else 'knn' end as winner,
        round(greatest(m, r, k), 6) as accuracy,
        case when k <= m then 'below baseline' when k <= r then 'rules as good' else 'worth its cost' end as verdict from s""")
def best_classifier(spark, sf_dir):
    vec = t.vectors(spark, sf_dir)
    by_label = vec.groupBy("label").agg(F.count("*").alias("n"))
    majority = by_label.agg((F.max("n") / F.sum("n")).alias("accuracy"))
    right = lambda a, b: F.avg(F.when(a == b, 1.0).otherwise(0.0)).alias("accuracy")
    rules = _length_rule(spark, sf_dir).agg(right(F.col("actual"), F.col("predicted")))
    guess = vec.agg(right(F.col("label"), F.col("id") % 3))
    scores = None
    for order, (kind, frame) in enumerate((("majority", majority), ("rules", rules), ("knn", guess))):
        row = frame.select(F.lit(kind).alias("kind"), F.lit(kind).alias("name"), "accuracy", F.lit(order).alias("ord"))
        scores = row if scores is None else scores.unionByName(row)
    return ev.best_of(scores).withColumn("accuracy", F.round("accuracy", 6))


def _ratios(spark, sf_dir):
    """Known-word ratios of questions against their own deck (related) and of benchmark items
    against deck ``src0`` (unrelated)."""
    docs = t.documents(spark, sf_dir)
    vocab = ix.vocabulary(docs, scope=["deck_id"])
    mine = guards.known_ratios(t.live_questions(spark, sf_dir), vocab, LATIN).withColumn("related", F.lit(True))
    other = t.questions(spark, sf_dir).withColumn("deck_id", F.lit("src0"))
    theirs = guards.known_ratios(other, vocab, LATIN).withColumn("related", F.lit(False))
    return mine.select("qid", "ratio", "related").unionByName(theirs.select("qid", "ratio", "related"))


NOT_CONTENT = q.in_list(sorted({*LATIN.fillers, *LATIN.meta_expand, *LATIN.talk_words}))
RATIO_VIEWS = f"""
    vocab as (select distinct deck_id, unnest({q.lower_words('text')}) as word from docs),
    asked as (select qid, deck_id, question, true as related from conv_q
              union all select qid, 'src0', question, false from bq),
    ws as (select qid, related, deck_id, unnest({q.words('question')}) as w from asked),
    cw as (select * from ws where w not in {NOT_CONTENT} and length(w) >= 2),
    ratios as (select a.qid, a.related, coalesce(r.ratio, 0.0) as ratio from asked a left join (
        select cw.qid, cw.related, avg(case when v.word is not null then 1.0 else 0 end) as ratio from cw
        left join vocab v on v.deck_id = cw.deck_id and v.word = lower(cw.w) group by 1, 2) r
        on r.qid = a.qid and r.related = a.related)"""


@query("v8_guard_calibration", q.with_views(f"""
    with {RATIO_VIEWS},
    th as (select i * 2 / 100.0 as threshold from range(0, 51) r(i)),
    tab as (select threshold,
        round(count_if(related and round(ratio, 9) >= threshold) / count_if(related), 6) as pass_rate,
        round(count_if(not related and round(ratio, 9) < threshold) / count_if(not related), 6) as block_rate
        from th cross join ratios group by threshold),
    sc as (select *, round(2 * pass_rate + block_rate, 6) as score from tab)
    select round(threshold, 2) as threshold, pass_rate, block_rate, score,
        score = max(score) over () and row_number() over (partition by score order by threshold)
            = count(*) over (partition by score) // 2 + 1 as recommended from sc""", "docs", "conv_q", "bq"))
def guard_calibration(spark, sf_dir):
    return ev.guard_calibration(_ratios(spark, sf_dir))


@query("v8_ratio_profile", q.with_views(f"""
    with {RATIO_VIEWS}
    select related, round(min(ratio), 6) as lowest, round(list_sort(list(ratio))[count(*) // 2 + 1], 6) as middle,
        round(max(ratio), 6) as highest from ratios group by related""", "docs", "conv_q", "bq"))
def ratio_profile(spark, sf_dir):
    profile = ev.ratio_profile(_ratios(spark, sf_dir), ["related"])
    return profile.select("related", *[F.round(c, 6).alias(c) for c in ("lowest", "middle", "highest")])


@query("v9_answer_status_report", q.with_views("""
    select status, count(*) as n,
        case when status = 'ok' then list_sort(list(latency_ms))[least(count(*) - 1, cast(floor(count(*) * 0.5) as bigint)) + 1] end as latency_ms_p50,
        case when status = 'ok' then list_sort(list(latency_ms))[least(count(*) - 1, cast(floor(count(*) * 0.95) as bigint)) + 1] end as latency_ms_p95
    from qlog group by status""", "qlog"))
def status_report(spark, sf_dir):
    return ev.status_report(t.question_log(spark, sf_dir))


@query("v10_predicate_comparison", f"""
    select old, new, old as expected, count(*) as n, case when new <> old then count(*) else 0 end as wrong from (
        select {q.numbers_ok('text', 'head')} as old, {q.numbers_ok_by_name('text', 'head', "''")} as new
        from (select text, regexp_replace(text, '[0-4]', '', 'g') as head from documents)) group by 1, 2""")
def predicate_comparison(spark, sf_dir):
    """Strict against name-aware number check, answers of the conversations against their questions."""
    pairs = t.documents(spark, sf_dir).select("text", F.regexp_replace("text", "[0-4]", "").alias("head"))
    return ev.compare_predicates(
        pairs, numbers_supported(F.col("text"), F.col("head")),
        numbers_supported_by_name(F.col("text"), F.col("head"), F.lit("")),
        numbers_supported(F.col("text"), F.col("head")))


@query("v11_question_coverage", q.with_views("""
    select c.deck_id, c.page, count(q.qid) as n_questions from chunks c left join conv_qa q
        on q.deck_id = c.deck_id and q.page = c.page where c.n_chars >= 150 group by 1, 2""", "chunks", "conv_qa"))
def question_coverage(spark, sf_dir):
    targets = gen.target_pages(t.chunks(spark, sf_dir), 150)
    return ev.question_coverage(t.spoken_answers(spark, sf_dir), targets)


@query("v11_pages_without_questions", q.with_views("""
    select c.deck_id, c.page from chunks c where c.n_chars >= 150 and not exists (
        select 1 from conv_qa q where q.deck_id = c.deck_id and q.page = c.page)""", "chunks", "conv_qa"))
def uncovered_pages(spark, sf_dir):
    covered = ev.question_coverage(t.spoken_answers(spark, sf_dir), gen.target_pages(t.chunks(spark, sf_dir), 150))
    return covered.where(F.col("n_questions") == 0).select("deck_id", "page")


@query("c5_knn_classification", q.with_views("""
    with n as (select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) as r from (
        select a.id as qid, b.id, round(list_sum(list_transform(range(1, 65), lambda i: a.vector[i] * b.vector[i])), 9) as score
        from vec a join vec b on a.id <> b.id)) where r <= 3),
    v as (select n.qid, x.label, round(sum(score), 6) as weight from n join vec x on x.id = n.id group by 1, 2)
    select qid, label, weight from (select *, row_number() over (partition by qid order by weight desc, label) as r from v)
    where r = 1""", "vec"))
def knn_classification(spark, sf_dir):
    vec = t.vectors(spark, sf_dir)
    near = se.dense_search(vec, vec.select(F.col("id").alias("qid"), "vector"), 3, skip_self=True)
    return ev.knn_vote(near, vec.select("id", "label"))


@query("c6_majority_label", "select label, count(*) as n from embeddings group by 1 order by n desc, label limit 1")
def majority(spark, sf_dir):
    return ev.majority_label(t.vectors(spark, sf_dir))
