"""Practice, coverage and weakness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.profiles import LATIN
from ..functions.text import content_words
from ..operators import evidence as ev
from ..operators import practice as pr
from ..sources import tables as t
from . import sql as q
from . import decks
from .registry import query


def _simple(spark, sf_dir):
    """Spoken answers judged on three facts taken from the question, so SQL can follow."""
    facts = F.array_distinct(content_words(F.col("question")))
    pairs = t.spoken_answers(spark, sf_dir).select(
        "qid", "deck_id", "page", "question", "answer", facts.alias("facts"), F.col("question").alias("snippet"),
        F.concat_ws(" ", "question", "answer").alias("page_text"), (F.col("turn") % 4).cast("string").alias("qtype"))
    return pr.judge(pairs)


JUDGED = f"""f as (select qid, deck_id, page, question, answer, cast(turn % 4 as varchar) as qtype, list_filter(list_transform(
        range(1, len(ws) + 1), lambda i: case when list_position(ws, ws[i]) = i then ws[i] end), lambda w: w is not null) as facts
        from (select *, {q.words('question')} as ws from conv_qa)),
    j as (select *, list_filter(facts, lambda x: contains(lower({q.squeeze('answer')}), lower({q.squeeze('x')}))) as covered from f),
    judged as (select *, len(facts) - len(covered) as n_missed, case when len(facts) > 0 then len(covered) / len(facts) else 0 end as ratio,
        len(facts) > 0 as measurable from j)"""


@query("p1_coverage", q.with_views(f"with {JUDGED} select qid, array_to_string(covered, ' ') as covered, n_missed, round(ratio, 6) as ratio, measurable from judged", "conv_qa"))
def coverage(spark, sf_dir):
    return _simple(spark, sf_dir).select("qid", F.array_join("covered", " ").alias("covered"), F.size("missed").alias("n_missed"),
                                         F.round("ratio", 6).alias("ratio"), "measurable")


@query("p1_page_facts")
def page_facts(spark, sf_dir):
    chunks, vocab = decks.pages(spark, sf_dir), decks.vocabulary(spark, sf_dir)
    judged = pr.judge(pr.with_facts(t.spoken_answers(spark, sf_dir), chunks, vocab, LATIN))
    return judged.select("qid", "page", F.array_join("facts", " ").alias("facts"), F.array_join("missed", " ").alias("missed"),
                         F.round("ratio", 6).alias("ratio"), "off_line")


@query("p2_weak_facts", q.with_views(f"""with {JUDGED}, e as (select deck_id, page, unnest(facts) as fact, covered from judged)
    select deck_id, page, fact, count(*) as asked, count_if(not list_contains(covered, fact)) as missed from e group by 1, 2, 3""", "conv_qa"))
def weak_facts(spark, sf_dir):
    return pr.weak_facts(_simple(spark, sf_dir))


@query("p2_weak_facts_added_up", q.with_views(f"""with {JUDGED}, e as (select deck_id, page, unnest(facts) as fact, covered from judged)
    select deck_id, page, fact, 2 * count(*) as asked, 2 * count_if(not list_contains(covered, fact)) as missed from e group by 1, 2, 3""", "conv_qa"))
def weak_facts_added_up(spark, sf_dir):
    judged = _simple(spark, sf_dir)
    return pr.weak_facts(judged, stored=pr.weak_facts(judged))


TYPES = "select qtype, count(*) as asked, round(sum(case when len(facts) > 0 then ratio else 1.0 end), 6) as covered from judged group by 1"


@query("p2_weak_types", q.with_views(f"with {JUDGED} {TYPES}", "conv_qa"))
def weak_types(spark, sf_dir):
    return pr.weak_types(_simple(spark, sf_dir)).withColumn("covered", F.round("covered", 6))


@query("p3_miss_rates", q.with_views(f"""with {JUDGED}, e as (select deck_id, page, unnest(facts) as fact, covered from judged)
    select deck_id, page, fact, round(count_if(not list_contains(covered, fact)) / count(*), 6) as miss_rate,
        round(2.0 * count_if(not list_contains(covered, fact)) / count(*), 6) as boost from e group by 1, 2, 3""", "conv_qa"))
def miss_rates(spark, sf_dir):
    return pr.miss_rates(pr.weak_facts(_simple(spark, sf_dir))).select(
        "deck_id", "page", "fact", F.round("miss_rate", 6).alias("miss_rate"), F.round("boost", 6).alias("boost"))


@query("p4_weak_type_flags", q.with_views(f"with {JUDGED}, ty as ({TYPES}) select qtype, covered / asked < 0.6 as weak from ty", "conv_qa"))
def weak_type_flags(spark, sf_dir):
    return pr.flag_weak_types(pr.weak_types(_simple(spark, sf_dir))).select("qtype", "weak")


@query("p5_most_missed", q.with_views(f"""with {JUDGED}, e as (select deck_id, page, unnest(facts) as fact, covered from judged),
    r as (select deck_id, page, fact, count(*) as asked, count_if(not list_contains(covered, fact)) as missed from e group by 1, 2, 3)
    select *, round(missed / asked, 9) as miss_rate from r where missed > 0 order by round(missed / asked, 9) desc, missed desc, deck_id, page, fact limit 10""", "conv_qa"))
def most_missed(spark, sf_dir):
    return pr.most_missed(pr.weak_facts(_simple(spark, sf_dir)))


@query("p6_drill_summary", q.with_views(f"""with {JUDGED} select count(*) as n, round(avg(case when measurable then ratio end), 6) as mean_ratio,
    count_if(not measurable) as n_unmeasurable from judged""", "conv_qa"))
def drill_summary(spark, sf_dir):
    return pr.drill_summary(_simple(spark, sf_dir))


@query("p6_weakest_answers", q.with_views(f"with {JUDGED} select qid, round(ratio, 6) as ratio from judged order by ratio, qid limit 3", "conv_qa"))
def weakest_answers(spark, sf_dir):
    return pr.weakest_answers(_simple(spark, sf_dir)).select("qid", F.round("ratio", 6).alias("ratio"))


def drill_input(spark, sf_dir):
    """One drill per conversation: the first user turn asks, the assistant turns answer."""
    turns = t.table(spark, sf_dir, "conversations")
    facts = F.array_distinct(content_words(F.col("text")))
    opening = turns.where(F.col("turn") == 0).select(
        F.col("conv_id").alias("qid"), F.col("text").alias("question"), facts.alias("facts"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("and what else?")).otherwise("").alias("followup"))
    said = turns.where(F.col("turn") % 2 == 1).select(
        F.col("conv_id").alias("qid"), F.floor((F.col("turn") - 1) / 2).cast("int").alias("depth"), F.col("text").alias("answer"))
    return opening.join(said, "qid")


@query("p7_drill", q.with_views(f"""
    with o as (select conv_id as qid, list_filter(list_transform(range(1, len(ws) + 1), lambda i: case when list_position(ws, ws[i]) = i then ws[i] end),
            lambda w: w is not null) as facts from (select *, {q.words('text')} as ws from conversations where turn = 0)),
    a as (select o.qid, cast((turn - 1) // 2 as integer) as depth, facts, lower({q.squeeze('text')}) as said from o join conversations c on c.conv_id = o.qid and c.turn % 2 = 1),
    m as (select x.qid, x.depth, x.facts, list_filter(x.facts, lambda f: not contains(string_agg(y.said, '|' order by y.depth), lower({q.squeeze('f')}))) as missed
          from a x join a y on y.qid = x.qid and y.depth <= x.depth where x.depth <= 2 group by x.qid, x.depth, x.facts),
    d as (select qid, depth, len(missed) as n_missing, case when len(facts) > 0 then (len(facts) - len(missed)) / len(facts) else 1.0 end as ratio,
          depth >= 2 or (len(list_filter(missed, lambda f: regexp_matches(f, '^[0-9]'))) = 0
            and case when len(facts) > 0 then (len(facts) - len(missed)) / len(facts) else 1.0 end >= 0.7) as done from m)
    select qid, depth, n_missing, round(ratio, 6) as ratio, done from d x where not exists (select 1 from d y where y.qid = x.qid and y.depth < x.depth and y.done)"""))
def drill(spark, sf_dir):
    return pr.drill_turns(drill_input(spark, sf_dir)).select("qid", "depth", "n_missing", F.round("ratio", 6).alias("ratio"), "done")


@query("p3_boosted_keywords")
def boosted_keywords(spark, sf_dir):
    """Practice feeds back into the live path: missed facts move to the front of the keywords."""
    from .evidence import _path
    chunks, vocab = decks.pages(spark, sf_dir), decks.vocabulary(spark, sf_dir)
    judged = pr.judge(pr.with_facts(t.spoken_answers(spark, sf_dir), chunks, vocab, LATIN))
    hits, asked, pages = _path(spark, sf_dir, chunks, vocab)
    found = ev.evidence(hits, asked, pages, pr.miss_rates(pr.weak_facts(judged)), LATIN)
    return found.select("qid", "place", F.array_join("keywords", " ").alias("keywords"))
