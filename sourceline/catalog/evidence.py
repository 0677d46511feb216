"""Evidence lines, keywords and the whole question path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.profiles import LATIN
from ..functions.text import content_words
from ..operators import evidence as ev
from ..operators import guards as gd
from ..operators import index as ix
from ..operators import knowledge as kb
from ..operators import notes as nt
from ..operators import search as se
from ..plans.cue import choose_answer, cue
from ..plans.materialize import stored
from ..sources import tables as t
from . import sql as q
from . import decks
from .registry import query


def _path(spark, sf_dir, chunks=None, vocab=None):
    """Hits, question context and page context of the questions that pass the guard."""
    chunks, vocab = chunks or decks.pages(spark, sf_dir), vocab or decks.vocabulary(spark, sf_dir)
    index = decks.index(spark, sf_dir)
    guarded = gd.guard_questions(t.live_questions(spark, sf_dir), vocab, LATIN)
    live = stored(guarded.where(F.col("status").isNull()), "live")
    hits = stored(se.bm25_search(index, live.select("qid", "deck_id", F.col("query").alias("question")), 3), "hits")
    return hits, ev.question_context(live, vocab, LATIN), ev.page_context(chunks, vocab, only=hits)


def _pairs(spark, sf_dir):
    hits, asked, pages = _path(spark, sf_dir)
    return ev.question_pages(hits.select("qid", "id", "rank"), asked, pages.drop("deck_id"))


@query("e1_word_overlap", q.with_views("select qid, id, idx, round(score, 6) as score, n from line_overlaps", "line_overlaps"))
def word_overlap(spark, sf_dir):
    found = ev.line_overlaps(_pairs(spark, sf_dir)).select("qid", "id", F.explode("overlaps").alias("o"))
    return found.select("qid", "id", "o.idx", F.round("o.score", 6).alias("score"), "o.n")


@query("e2_raw_keys", q.with_views("select qid, key from raw_keys", "raw_keys"))
def raw_keys(spark, sf_dir):
    vocab = decks.vocabulary(spark, sf_dir)
    guarded = gd.guard_questions(t.live_questions(spark, sf_dir), vocab, LATIN)
    return ev.question_context(guarded, vocab, LATIN).select("qid", F.explode("raw").alias("key"))


@query("e3_line_scores", q.with_views("select qid, id, idx, round(score, 6) as score, n from line_scores", "line_scores"))
def line_scores(spark, sf_dir):
    scored = ev.score_lines(_pairs(spark, sf_dir), LATIN)
    return scored.select("qid", "id", F.explode("scored").alias("s")).select(
        "qid", "id", "s.idx", F.round("s.score", 6).alias("score"), "s.n")


@query("e4_page_rerank", q.with_views("select qid, id, place, round(total, 6) as total, idx from picked", "picked"))
def page_rerank(spark, sf_dir):
    picked = ev.rerank_pages(ev.best_lines(_pairs(spark, sf_dir), LATIN).where(F.col("best").isNotNull()))
    return picked.select("qid", "id", "place", F.round("total", 6).alias("total"), "best.idx")


def _evidence(spark, sf_dir):
    hits, asked, pages = _path(spark, sf_dir)
    return ev.evidence(hits, asked, pages, profile=LATIN)


SNIPPET = f"substr(regexp_replace(line, {q.quote(q.SHOWN_BULLET)}, ''), 1, 120)"


@query("e5_sources", q.with_views(f"select qid, place, page, {SNIPPET} as snippet, deck_id as source from picked", "picked"))
def sources(spark, sf_dir):
    return _evidence(spark, sf_dir).select("qid", "place", "page", "snippet", F.col("deck_id").alias("source"))


@query("e6_line_keywords", q.with_views("select qid, place, array_to_string(kws, ' ') as keywords from keyword_lists", "keyword_lists"))
def line_keywords(spark, sf_dir):
    return _evidence(spark, sf_dir).where(F.size("keywords") > 0).select("qid", "place", F.array_join("keywords", " ").alias("keywords"))


@query("e6_merged_keywords", q.with_views("""
    with f as (select qid, place, unnest(kws) as w, unnest(range(1, len(kws) + 1)) as i from keyword_lists),
    u as (select qid, w, min(place * 10 + i) as o from f group by 1, 2)
    select qid, array_to_string(list_sort(list({'o': o, 'w': w}))[1:6].list_transform(lambda x: x.w), ' ') as keywords from u group by 1""",
    "keyword_lists"))
def merged_keywords(spark, sf_dir):
    return ev.gather_sources(_evidence(spark, sf_dir)).where(F.size("keywords") > 0).select(
        "qid", F.array_join("keywords", " ").alias("keywords"))


FACT_STOP = q.in_list(sorted({*LATIN.stopwords, *LATIN.generic}))
KEY_FACTS = f"""
    ws as (select qid, id, deck_id, line, ls[p] as w, p from (select qid, id, deck_id, line, {q.words('line')} as ls,
           unnest(range(1, len({q.words('line')}) + 1)) as p from best_lines)),
    nums as (select qid, id, w, min(p) as p from ws where {q.is_number('w')} and {q.useful_number('w')} group by all),
    plain as (select * from (select ws.*, row_number() over (partition by qid, id, lower(w) order by p) as nth from ws
        where not {q.is_number('w')} and length(w) >= 2 and w not in {FACT_STOP}
          and not regexp_matches(line, '[가-힣A-Za-z\\-]\\Q' || w || '\\E') and not regexp_matches(line, '\\Q' || w || '\\E[가-힣]')) where nth = 1),
    scored as (select p.*, round(coalesce(v.idf, 0), 9) as s from plain p left join vocab v on v.deck_id = p.deck_id and v.word = lower(p.w)),
    ranked as (select qid, id, w, 1 as g, row_number() over (partition by qid, id order by s desc, p) as r from scored where s >= 1.6
        union all select qid, id, w, 0, row_number() over (partition by qid, id order by p) from nums),
    facts as (select qid, id, list(w order by g, r) filter (where g = 0 or r <= 6 - coalesce(n, 0)) as fs from ranked
        left join (select qid, id, count(*) as n from nums group by 1, 2) using (qid, id) group by 1, 2)"""


@query("e7_key_facts", q.with_views(f"with {KEY_FACTS} select qid, id, array_to_string(fs, ' ') as facts from facts where len(fs) > 0",
                                    "best_lines", "vocab"))
def key_facts(spark, sf_dir):
    best = ev.best_lines(_pairs(spark, sf_dir), LATIN)
    facts = ev.key_facts(F.col("best.line"), F.col("best.words"), F.col("best.keys"), LATIN)
    return best.where(F.col("best").isNotNull()).select("qid", "id", F.array_join(facts, " ").alias("facts")).where(F.col("facts") != "")


CUES = f"""
    select g.qid, coalesce(g.status, 'ok') as status, case when g.status = 'ignored' then '' else {q.qtype('g.question')} end as question_type,
        coalesce(s.n, 0) as n_sources, s.first_page,
        case when g.status is null and {q.qtype('g.question')} = 'limit' then {len(LATIN.deflect)} else 0 end as n_deflect,
        case when g.status = 'no_evidence' then {len(LATIN.advice)} else 0 end as n_advice
    from guarded g left join (select qid, count(*) as n, min_by(page, place) as first_page from picked group by 1) s using (qid)"""


@query("e8_cue", q.with_views(CUES,
    "guarded", "picked"))
def cues(spark, sf_dir):
    chunks, vocab, index = decks.pages(spark, sf_dir), decks.vocabulary(spark, sf_dir), decks.index(spark, sf_dir)
    out = cue(t.live_questions(spark, sf_dir), chunks, index, vocab, LATIN)
    return _shown(out)


def _shown(out):
    return out.select("qid", "status", "question_type", F.size("sources").alias("n_sources"),
                      F.get("sources", F.lit(0))["slide"].alias("first_page"),
                      F.size("deflect").alias("n_deflect"), F.size("advice").alias("n_advice"))


PASSAGE_HITS = f"""with ps as (select p.*, d.deck_id from passages p join docs d using (id)),
    p as (select deck_id, id, passage, dl, term, count(*) as tf from (select deck_id, id, passage, len(tk) as dl, unnest(tk) as term
          from (select *, {q.tokens('text')} as tk from ps)) group by all),
    sz as (select deck_id, count(*) as n, sum(len({q.tokens('text')})) / count(*) as avgdl from ps group by 1),
    st as (select deck_id, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf, any_value(avgdl) as avgdl from p join sz using (deck_id) group by 1, 2),
    sc as (select qid, deck_id, id, passage, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score
           from dqterms join st using (deck_id, term) join p using (deck_id, term) group by 1, 2, 3, 4),
    pool as (select * from (select *, row_number() over (partition by qid order by score desc, id || '/' || lpad(cast(passage as varchar), 5, '0')) as r from sc) where r <= 60),
    best as (select qid, deck_id, id, max(score) as score from pool group by 1, 2, 3)
    select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from best) where rank <= 3"""


@query("e8_cue_passages", q.with_views(CUES, "guarded", "picked", instead={"dhits": (PASSAGE_HITS, ("passages", "docs", "dqterms"))}))
def passage_cues(spark, sf_dir):
    """The question path with another retriever: line windows of the question's own deck."""
    chunks, vocab, docs = decks.pages(spark, sf_dir), decks.vocabulary(spark, sf_dir), t.documents(spark, sf_dir)
    return _shown(cue(t.live_questions(spark, sf_dir), chunks, None, vocab, LATIN, search=lambda asked, k: se.passage_search(docs, asked, k, scope=["deck_id"])))


def _cards(spark, sf_dir):
    """An approved card for one kind in every second deck."""
    chunks = t.chunks(spark, sf_dir)
    decks = chunks.groupBy("deck_id").agg(F.count("*").alias("n")).where(F.pmod(F.hash("deck_id"), F.lit(2)) >= 0)
    steps = F.array(*[F.struct(F.lit(f"step {i} nicht sich").alias("text"), F.lit(p).cast("int").alias("slide"))
                      for i, p in enumerate((1, 2, 1))])
    return decks.select("deck_id", F.explode(F.array(*[F.lit(k.id) for k in LATIN.core_kinds])).alias("core_id")).withColumn("steps", steps)


@query("e9_core_card_cue")
def core_card_cue(spark, sf_dir):
    chunks, vocab, index = decks.pages(spark, sf_dir), decks.vocabulary(spark, sf_dir), decks.index(spark, sf_dir)
    short = t.live_questions(spark, sf_dir).withColumn("question", F.concat(F.lit("why "), F.regexp_extract("question", r"^(\S+) ", 1), F.lit("?")))
    out = cue(short, chunks, index, vocab, LATIN, cards=_cards(spark, sf_dir))
    return out.select("qid", "status", "core", "core_pending", "stage", F.array_join(F.col("sources.slide").cast("array<string>"), ",").alias("slides"))


def _note_matches(spark, sf_dir):
    """Notes of a conversation against the questions of the same conversation."""
    notes = t.notes(spark, sf_dir)
    vocab = ix.vocabulary(notes, scope=["deck_id"])
    asked = t.live_questions(spark, sf_dir).select("qid", F.col("conv_id").alias("deck_id"), "question")
    return notes, asked, vocab, ev.question_context(asked, vocab, LATIN)


NOTE_MATCH = f"""
    nv as (select deck_id, word, ln(1 + n / count(*)) as idf from (select n.deck_id, unnest({q.lower_words('n.text')}) as word, s.n
           from notes n join (select deck_id, count(*) as n from notes group by 1) s using (deck_id)) group by deck_id, word, n),
    nq as (select distinct qid, conv_id as deck_id, lower(w) as word from (select qid, conv_id, unnest({q.words('question')}) as w from conv_q)),
    nw as (select deck_id, id, ord, page, kind, unnest({q.lower_words('text')}) as word from notes),
    nm as (select qid, id, any_value(ord) as ord, any_value(page) as page, any_value(kind) as kind, round(sum(case when exact then coalesce(qi, 0) else 0.7 * near end), 9) as score, count(*) as n from (
        select a.qid, w.id, a.word, any_value(w.ord) as ord, any_value(w.page) as page, any_value(w.kind) as kind, any_value(v.idf) as qi, bool_or(w.word = a.word) as exact,
            max(case when length(a.word) >= 2 and length(w.word) >= 2 and not {q.is_number('w.word')}
                and (contains(w.word, a.word) or contains(a.word, w.word)) then x.idf end) as near
        from nq a join nw w on w.deck_id = a.deck_id join nv x on x.deck_id = w.deck_id and x.word = w.word
        left join nv v on v.deck_id = a.deck_id and v.word = a.word group by 1, 2, 3) where exact or near is not null group by 1, 2)"""


@query("e10_general_notes", q.with_views(f"""with {NOTE_MATCH} select qid, id, round(score, 6) as score, rank from (
    select *, cast(row_number() over (partition by qid order by score desc, ord) as integer) as rank from nm
    where page is null and kind in ('explain', 'fact')) where rank <= 3""", "notes", "conv_q"))
def general_notes(spark, sf_dir):
    notes, _, vocab, asked = _note_matches(spark, sf_dir)
    general = nt.general_notes(notes)
    best = ev.best_texts(ev.match_texts(general, asked, vocab), general)
    return best.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("e11_fallback_notes", q.with_views(f"""with {NOTE_MATCH} select qid, id, round(score, 6) as score, rank from (
    select *, cast(row_number() over (partition by qid order by score desc, ord) as integer) as rank from (
        select a.qid, n.id, n.ord, coalesce(nm.score, 0) as score from (select distinct qid, conv_id as deck_id from conv_q) a
        join notes n on n.deck_id = a.deck_id and n.kind in ('explain', 'fact') left join nm on nm.qid = a.qid and nm.id = n.id))
    where rank <= 10""", "notes", "conv_q"))
def fallback_notes(spark, sf_dir):
    notes, asked, vocab, context = _note_matches(spark, sf_dir)
    usable = notes.where(F.col("kind").isin(*kb.ANSWER_KINDS))
    found = ev.fallback_notes(ev.match_texts(usable, context, vocab), asked, usable)
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("e11_fallback_evidence", q.with_views(f"""with {NOTE_MATCH},
    pk as (select * from (select *, row_number() over (partition by qid order by score desc, ord) as rank from (
        select a.qid, n.id, n.ord, n.page, n.text, coalesce(nm.score, 0) as score from (select distinct qid, conv_id as deck_id from conv_q) a
        join notes n on n.deck_id = a.deck_id and n.kind in ('explain', 'fact') left join nm on nm.qid = a.qid and nm.id = n.id)) where rank <= 10),
    base as (select a.qid, c.page, c.text from conv_q a join chunks c on c.deck_id = a.deck_id and c.page between 1 and a.turn % 5
        union all select qid, 0, question from conv_q where turn % 3 = 0),
    added as (select distinct p.qid, c.page, c.text from pk p join conv_q a using (qid) join chunks c on c.deck_id = a.deck_id and c.page = p.page),
    merged as (select qid, page, coalesce(b.text, d.text) as text, b.text is null as added from (select * from base where page <> 0) b full join added d using (qid, page)),
    gen as (select qid, string_agg('[note] ' || text, chr(10) order by rank) as text from pk where page is null group by 1),
    gains as (select qid from merged where added union select qid from gen g full join (select * from base where page = 0) b using (qid) where g.text is distinct from b.text)
    select qid, page, md5(text) as digest from (select qid, page, text from merged union all select qid, 0, text from gen) where qid in (select qid from gains) and qid in (select qid from pk)""", "notes", "conv_q", "chunks"))
def fallback_evidence(spark, sf_dir):
    """Pages found for a question, merged with those of its fallback notes; only where that adds something."""
    notes, asked, vocab, context = _note_matches(spark, sf_dir)
    usable = notes.where(F.col("kind").isin(*kb.ANSWER_KINDS))
    picked = stored(ev.fallback_notes(ev.match_texts(usable, context, vocab), asked, usable), "fallback-notes")
    questions, pages = t.live_questions(spark, sf_dir), t.chunks(spark, sf_dir).select("deck_id", "page", "text")
    # a question names its pages, so it does not meet all pages of its deck
    named = F.explode(F.when(F.col("turn") % 5 >= 1, F.sequence(F.lit(1), (F.col("turn") % 5).cast("int"))))
    near = questions.select("qid", "deck_id", named.alias("page")).join(pages, ["deck_id", "page"]).select("qid", "page", "text")
    base = near.unionByName(questions.where(F.col("turn") % 3 == 0).select("qid", F.lit(0).alias("page"), F.col("question").alias("text")))
    return ev.fallback_evidence(base, picked, questions, pages, "[note] ").select("qid", "page", F.md5("text").alias("digest"))


@query("e12_answer_choice", q.with_views("""
    with s as (select qid, deck_id, case qid % 4 when 0 then 'ok' when 1 then 'no_answer' when 2 then 'blocked' else 'no_answer' end as s0,
        case when qid % 4 in (0, 2) and qid % 3 = 0 then 'part' else '' end as t0, qid % 5 <> 0 as has_notes,
        case when qid % 7 = 0 then 'no_answer' else 'ok' end as s1, qid % 2 = 0 as rel from conv_q),
    b as (select *, case when s0 <> 'no_answer' or not has_notes then 0 else 1 end as base from s),
    c as (select *, case when base = 0 then s0 else s1 end as bs, case when base = 0 then t0 else 'notes' end as bt from b)
    select qid, cast(case when rel and (bs = 'no_answer' or (bs = 'blocked' and bt = '')) then 2 else base end as integer) as tier,
        case when rel and (bs = 'no_answer' or (bs = 'blocked' and bt = '')) then 'ok' else bs end as status from c""", "conv_q"))
def answer_choice(spark, sf_dir):
    qid = F.col("qid")
    asked = t.live_questions(spark, sf_dir)
    slide = asked.select("qid", F.lit(0).alias("tier"), F.when(qid % 4 == 0, "ok").when(qid % 4 == 2, "blocked").otherwise("no_answer").alias("status"),
                         F.when((qid % 4).isin(0, 2) & (qid % 3 == 0), "part").otherwise("").alias("text"), (qid % 2 == 0).alias("related"))
    spoken = asked.where(qid % 5 != 0).select("qid", F.lit(1).alias("tier"), F.when(qid % 7 == 0, "no_answer").otherwise("ok").alias("status"),
                                              F.lit("notes").alias("text"), (qid % 2 == 0).alias("related"))
    guess = asked.select("qid", F.lit(2).alias("tier"), F.lit("ok").alias("status"), F.lit("guess").alias("text"), (qid % 2 == 0).alias("related"))
    return choose_answer(slide.unionByName(spoken).unionByName(guess)).select("qid", "tier", "status")


@query("e13_answer_context", q.with_views("""
    with h as (select qid, id, rank from bm25_rank where rank <= 8),
    p as (select h.qid, cast(h.id % 3 as integer) as page, h.rank, case when h.id % 2 = 0 then 'slide' else 'script' end as kind,
        d.text from h join docs d using (id)),
    l as (select qid, page, min(rank) as rank, line from (select *, case when kind = 'slide' then text when page <> 0 then '[발표자 설명] ' || text
        else '[발표 대본] ' || text end as line from p) group by qid, page, line)
    select qid, page, cast(min(rank) as integer) as ord, md5(string_agg(line, chr(10) order by rank)) as digest from l group by 1, 2""",
    "bm25_rank", "docs"))
def answer_context(spark, sf_dir):
    docs = t.documents(spark, sf_dir)
    hits = se.bm25_search(ix.build_index(docs), t.questions(spark, sf_dir), 8)
    picked = hits.join(docs.select("id", "text"), "id").select(
        "qid", "rank", (F.col("id") % 3).cast("int").alias("page"),
        F.when(F.col("id") % 2 == 0, "slide").otherwise("script").alias("kind"), "text")
    return kb.answer_context(picked).select("qid", "page", "ord", F.md5("text").alias("digest"))


REFINED = """ref as (select deck_id, page, case when page % 6 = 0 then '## tiny' else
    '## head' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- ') end as text from chunks where page % 3 = 0)"""


@query("t9_refined_else_raw", q.with_views(rf"""with {REFINED},
    rl as (select deck_id, page, count(*) as n from (select deck_id, page, {q.strip(r"regexp_replace(l, '^\s*(?:#+\s*|[-•*]\s*)', '')")} as line
        from (select deck_id, page, unnest(string_split(text, chr(10))) as l from ref)) where length(line) > 6 group by 1, 2),
    raw as (select deck_id, page, count(*) as n from lines group by 1, 2)
    select c.deck_id, c.page, coalesce(rl.n, 0) > 0 as from_refined, coalesce(rl.n, raw.n, 0) as n_lines from chunks c
    left join rl using (deck_id, page) left join raw using (deck_id, page)""", "chunks", "lines"))
def refined_else_raw(spark, sf_dir):
    chunks = t.chunks(spark, sf_dir)
    refined = chunks.where(F.col("page") % 3 == 0).select("deck_id", "page", F.when(F.col("page") % 6 == 0, "## tiny").otherwise(
        F.concat(F.lit("## head\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))).alias("text"))
    return ev.page_lines(chunks, refined).select("deck_id", "page", "from_refined", F.size("lines").alias("n_lines"))
