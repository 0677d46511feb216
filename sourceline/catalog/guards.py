"""Predicates, guards and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as nb
from ..functions.profiles import LATIN
from ..functions.text import content_words
from ..operators import classify as cl
from ..operators import generated as gen
from ..operators import guards as gd
from ..operators import search as se
from ..sources import tables as t
from . import sql as q
from . import decks
from .registry import query


def _vocab(spark, sf_dir):
    return decks.vocabulary(spark, sf_dir)


def _short_said(spark, sf_dir):
    """Questions, some of them cut short enough to be noise."""
    turns = t.live_questions(spark, sf_dir)
    return turns.withColumn("question", F.when(F.col("qid") % 3 == 0, F.substring("question", 1, 7)).otherwise(F.col("question")))


NOISE = f"""length({q.strip('question')}) < 6 or case when len({q.words('question')}) = 0
    then not regexp_matches(question, {q.quote(LATIN.question_cue)})
    else len(list_filter({q.words('question')}, lambda w: w not in {q.in_list(LATIN.fillers)})) = 0 end"""


@query("g1_noise", q.with_views(f"""select qid, {NOISE} as noise from (
    select qid, case when qid % 3 = 0 then substr(question, 1, 7) else question end as question from conv_q)""", "conv_q"))
def noise(spark, sf_dir):
    return _short_said(spark, sf_dir).select("qid", gd.is_noise(F.col("question"), LATIN).alias("noise"))


@query("g2_known_word_ratio", q.with_views("select qid, n_content, round(ratio, 6) as ratio, ratio < 0.26 as no_evidence from ratios", "ratios"))
def known_ratio(spark, sf_dir):
    rated = gd.known_ratios(t.live_questions(spark, sf_dir), _vocab(spark, sf_dir), LATIN)
    return rated.select("qid", "n_content", F.round("ratio", 6).alias("ratio"),
                        (F.col("ratio") < gd.MIN_KNOWN_RATIO).alias("no_evidence"))


@query("g3_meta_expansion", q.with_views("""select a.qid, coalesce(array_to_string(m.extra, ' '), '') as extra from asked a
    left join (select qid, list_sort(list(term)) as extra from meta_terms group by 1) m using (qid)""", "asked", "meta_terms"))
def meta_expansion(spark, sf_dir):
    expanded = gd.expand_meta(t.live_questions(spark, sf_dir), _vocab(spark, sf_dir), LATIN)
    return expanded.select("qid", F.array_join("extra", " ").alias("extra"))


@query("g3_guard_verdicts", q.with_views("select qid, coalesce(status, 'search') as status, md5(query) as query from guarded", "guarded"))
def guard_verdicts(spark, sf_dir):
    guarded = gd.guard_questions(t.live_questions(spark, sf_dir), _vocab(spark, sf_dir), LATIN)
    return guarded.select("qid", F.coalesce("status", F.lit("search")).alias("status"), F.md5("query").alias("query"))


@query("g4_target_pages", q.with_views("select deck_id, page from chunks where n_chars >= 80", "chunks"))
def target_pages(spark, sf_dir):
    return gen.target_pages(t.chunks(spark, sf_dir), 80).select("deck_id", "page")


def _head_and_text(spark, sf_dir):
    return t.documents(spark, sf_dir).select("id", "text", F.regexp_replace("text", "[0-4]", "").alias("head"))


@query("g5_numbers_supported", f"""select id, {q.numbers_ok('text', 'head')} as supported
    from (select doc_id as id, text, regexp_replace(text, '[0-4]', '', 'g') as head from documents)""")
def numbers_supported(spark, sf_dir):
    return _head_and_text(spark, sf_dir).select("id", nb.numbers_supported(F.col("text"), F.col("head")).alias("supported"))


HEAD_AND_TEXT = "(select doc_id as id, text, regexp_replace(text, '[0-4]', '', 'g') as head from documents)"


@query("g6_numbers_supported_by_name", f"select id, {q.numbers_ok_by_name('text', 'head', 'text')} as supported from {HEAD_AND_TEXT}")
def numbers_supported_by_name(spark, sf_dir):
    return _head_and_text(spark, sf_dir).select("id", nb.numbers_supported_by_name(
        F.col("text"), F.col("head"), F.col("text")).alias("supported"))


@query("g7_unsupported_numbers", f"""select id, number from (select id, head, unnest({q.numbers('text')}) as number
    from (select doc_id as id, text, regexp_replace(text, '[0-4]', '', 'g') as head from documents))
    where length(number) >= 2 and not contains({q.squeeze('head')}, replace(number, ',', ''))""")
def unsupported_numbers(spark, sf_dir):
    return _head_and_text(spark, sf_dir).select("id", F.explode(nb.unsupported_numbers(F.col("text"), F.col("head"))).alias("number"))


@query("g8_new_facts", f"select id, case when len({q.new_numbers('text', 'head')}) > 0 then 'fact' else 'explain' end as kind from {HEAD_AND_TEXT}")
def new_facts(spark, sf_dir):
    kind = gen.upgrade_new_facts(F.lit("explain"), F.col("text"), F.col("head"))
    return _head_and_text(spark, sf_dir).select("id", kind.alias("kind"))


@query("g9_leaks", q.with_views(f"""select qid, len(list_filter(facts, lambda f: contains(
        lower({q.squeeze('question')}), lower({q.squeeze('f')})))) > 0 as leaks
    from (select qid, question, {q.words('answer')} as facts from conv_qa)""", "conv_qa"))
def leaks(spark, sf_dir):
    facts = content_words(F.col("answer"))
    return t.spoken_answers(spark, sf_dir).select("qid", "question", facts.alias("facts")).select(
        "qid", gd.leaks(F.col("question"), F.col("facts")).alias("leaks"))


@query("g10_related", q.with_views(f"""
    select a.qid, a.qid % 5 = 0 or coalesce(r.hit, false) or len(list_filter({q.words('a.question')},
        lambda w: lower(w) in {q.in_list(LATIN.meta_expand)})) > 0 or regexp_matches(a.question, {q.quote(LATIN.related_cue)}) as related
    from asked a left join (select distinct aw.qid, true as hit from aw join vocab v on v.deck_id = aw.deck_id and v.word = lower(aw.w)
        where length(aw.w) >= 2 and lower(aw.w) not in {q.in_list(LATIN.fillers)}) r using (qid)""", "asked", "aw", "vocab"))
def related(spark, sf_dir):
    asked = t.live_questions(spark, sf_dir).withColumn("status", F.when(F.col("qid") % 5 == 0, "ok").otherwise("no_evidence"))
    return gd.related(asked, _vocab(spark, sf_dir), LATIN).select("qid", "related")


@query("g11_grounded_share", q.with_views(r"""
    with p as (select qid, regexp_replace(question, '[\s\p{Z}#*>\-|`"''.,()]', '', 'g') as a,
                      regexp_replace(answer, '[\s\p{Z}#*>\-|`"''.,()]', '', 'g') as b from conv_qa),
    g as (select qid, list_distinct(list_transform(range(1, greatest(length(a), 1)), lambda i: substr(a, cast(i as int), 2))) as x,
                 list_distinct(list_transform(range(1, greatest(length(b), 1)), lambda i: substr(b, cast(i as int), 2))) as y from p)
    select qid, round(case when len(x) > 0 then len(list_intersect(x, y)) / len(x) else 0 end, 6) as share from g""", "conv_qa"))
def grounded_share(spark, sf_dir):
    return t.spoken_answers(spark, sf_dir).select("qid", F.round(gd.grounded_share(
        F.col("question"), F.col("answer")), 6).alias("share"))


@query("g12_highlight_words", q.with_views(f"""
    select qid, array_to_string(list_slice(list_filter(list_transform(range(1, len(ks) + 1), lambda i:
        case when list_position(ks, ks[i]) = i then ks[i] end), lambda k: k is not null and length(k) >= 2
        and not regexp_matches(k, {q.quote(gd.NUMBER_AND_UNIT)}) and (contains(question, k) or contains(answer, k))), 1, 3), ' ') as keys
    from (select qid, question, answer, {q.words('answer')} as ks from conv_qa)""", "conv_qa"))
def highlight_words(spark, sf_dir):
    pairs = t.spoken_answers(spark, sf_dir)
    keys = gd.highlight_words(content_words(F.col("answer")), F.col("question"), F.col("answer"))
    return pairs.select("qid", F.array_join(keys, " ").alias("keys"))


@query("c1_question_type", q.with_views(f"select qid, {q.qtype('question')} as qtype from conv_q", "conv_q"))
def question_type(spark, sf_dir):
    return t.live_questions(spark, sf_dir).select("qid", cl.question_type(F.col("question"), LATIN).alias("qtype"))


EXPAND = "case " + " ".join(f"when k = {q.quote(k)} and {q.quote(v)} <> '' then question || ' ' || {q.quote(v)}"
                            for k, v in LATIN.query_expansion.items()) + " else question end"


@query("c2_type_expansion", q.with_views(f"select qid, md5({EXPAND}) as query from (select qid, question, {q.qtype('question')} as k from bq)", "bq"))
def type_expansion(spark, sf_dir):
    asked = se.expand_queries(t.questions(spark, sf_dir), lambda c: cl.expand_by_type(c, LATIN))
    return asked.select("qid", F.md5("question").alias("query"))


def _kinds_sql(text: str) -> str:
    parts = ", ".join(f"case when {' or '.join(f'contains({text}, {q.quote(w)})' for w in k.words)} then {q.quote(k.id)} end"
                      for k in LATIN.core_kinds)
    hits = f"list_filter([{parts}], lambda k: k is not null)"
    fewer = f"case when len({hits}) > 1 then list_filter({hits}, lambda k: k <> {q.quote(LATIN.summary_kind)}) else {hits} end"
    return f"case when len({fewer}) = 1 then ({fewer})[1] end"


@query("c3_core_kind", q.with_views(f"select qid, {_kinds_sql('question')} as core_id from conv_q", "conv_q"))
def core_kind(spark, sf_dir):
    return t.live_questions(spark, sf_dir).select("qid", cl.core_kind(F.col("question"), LATIN).alias("core_id"))


CORE_WORDS = sorted({w for k in LATIN.core_kinds for w in k.words})
NOT_CONTENT = q.in_list(sorted({*LATIN.fillers, *LATIN.meta_expand, *LATIN.talk_words}))


@query("c4_core_kind_of_bare_question", q.with_views(f"""
    select qid, case when len(list_filter({q.words('question')}, lambda w: length(w) >= 2 and w not in {NOT_CONTENT}
        and not ({' or '.join(f"contains(w, {q.quote(c)}) or contains({q.quote(c)}, w)" for c in CORE_WORDS)}))) = 0
        then {_kinds_sql('question')} end as core_id
    from (select qid, regexp_extract(question, '^\\S+ \\S+') as question from conv_q)""", "conv_q"))
def bare_core_kind(spark, sf_dir):
    first = t.live_questions(spark, sf_dir).withColumn("question", F.regexp_extract("question", r"^\S+ \S+", 0))
    return first.select("qid", cl.core_kind_of_bare_question(F.col("question"), LATIN).alias("core_id"))
