"""Generated-text tables. Responses are built from the documents themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.profiles import KOREAN, LATIN
from ..operators import generated as gen
from ..sources import stores
from ..sources import tables as t
from . import sql as q
from .registry import query


def _pages(spark, sf_dir):
    return t.chunks(spark, sf_dir).select("deck_id", "page", "doc_id", "text", "n_chars")


def _responses(spark, sf_dir, line):
    """One response per page of a deck: a few lines made from the page (``line``)."""
    return _pages(spark, sf_dir).select("deck_id", "page", "doc_id", "text", line.alias("response"))


def _alone(rows):
    """Every page as a deck of its own, so that each has a response."""
    return rows.withColumn("deck_id", F.concat_ws("#", "deck_id", num()))


def head():
    return F.regexp_replace("text", "[^A-Za-z]+", " ")


def num():
    return F.col("page").cast("string")


HEAD_SQL = "regexp_replace(text, '[^A-Za-z]+', ' ', 'g')"


@query("m1_generated_questions", q.with_views(f"""
    with r as (select deck_id, page, {q.strip(HEAD_SQL)} as h from chunks)
    select deck_id, page, h as question from r where length(h) >= 8 and page in (select page from chunks c where c.deck_id = r.deck_id and c.n_chars >= 150)
    union all select deck_id, page, 'why is this so' from r where page in (select page from chunks c where c.deck_id = r.deck_id and c.n_chars >= 150)""", "chunks"))
def generated_questions(spark, sf_dir):
    line = F.concat(num(), F.lit("\t"), head(), F.lit("\n"), F.lit("p."), num(), F.lit(" | why is this so\n999 | unknown page here\n"), num(), F.lit("\tshort"))
    return gen.parse_questions(_responses(spark, sf_dir, line), gen.target_pages(_pages(spark, sf_dir), 150)).select("deck_id", "page", "question")


@query("m2_attached_answers", q.with_views(f"""select deck_id, page, case when page % 3 = 0 then '' when page % 3 = 1 and not {q.numbers_ok("'it is 48151623'", 'text')} then ''
    when page % 3 = 1 then 'it is 48151623' else 'plain words' end as answer, page % 3 = 1 and not {q.numbers_ok("'it is 48151623'", 'text')} as dropped from chunks""", "chunks"))
def attached_answers(spark, sf_dir):
    said = F.when(F.col("page") % 3 == 0, "none").when(F.col("page") % 3 == 1, "it is 48151623").otherwise("plain words")
    responses = _responses(spark, sf_dir, F.concat(num(), F.lit(": first try\n"), num(), F.lit(": "), said))
    questions = _pages(spark, sf_dir).select("deck_id", "page", F.col("page").alias("number"))
    return gen.attach_answers(questions, responses, _pages(spark, sf_dir), LATIN).select(
        "deck_id", "page", "answer", "dropped")


KINDS = ["why", "limit", "plan"]


@query("m3_core_suggestions", q.with_views(f"""
    with d as (select deck_id || '#' || page as deck_id, page, text, {q.strip(HEAD_SQL)} as h from chunks),
    s as (select deck_id, page, text, 1 as pos, h as step from d union all select deck_id, page, text, 2, 'made up 77123' from d),
    ok as (select *, cast(row_number() over (partition by deck_id order by pos) as integer) as place from s where {q.numbers_ok('step', 'text')})
    select deck_id, 'why' as kind, 'ok' as status, place, page as slide, substr(step, 1, 30) as text from ok
    union all select deck_id, kind, 'no_answer', null, null, null from d, (values ('limit'), ('plan')) k(kind)""", "chunks"))
def core_suggestions(spark, sf_dir):
    line = F.concat(F.lit("## why\n"), num(), F.lit(" | "), head(), F.lit(" [3]\n"), num(), F.lit(" | made up 77123\n## limit\n999 | no such page"))
    return gen.core_suggestions(_alone(_responses(spark, sf_dir, line)), _alone(_pages(spark, sf_dir)), KINDS).select(
        "deck_id", "kind", "status", "place", "slide", "text")


@query("m4_steps_from_answer", q.with_views(f"""select qid, case when len(s) = 0 then '' else array_to_string(list_transform(s[1:3], lambda x: substr(x, 1, 30)), '|') end as steps from (
    select qid, list_filter(list_transform(string_split(answer, chr(10)), lambda l: {q.strip(r"regexp_replace(l, '^\s*(?:[0-9]+[.)]|[-•*])\s*', '')")}), lambda l: l <> '') as s from conv_qa)""", "conv_qa"))
def steps_from_answer(spark, sf_dir):
    steps = gen.steps_from_answer(F.regexp_replace("answer", "(?m)^", "- "), F.col("answer"))
    return t.spoken_answers(spark, sf_dir).select("qid", F.array_join(steps, "|").alias("steps"))


@query("m5_answer_warnings", q.with_views(f"""
    with a as (select doc_id as qid, deck_id, page, text || ' 48151623' as answer from chunks),
    runs as (select deck_id, unnest(regexp_extract_all({q.squeeze('text')}, '[0-9][0-9.]*')) as run from chunks),
    n as (select distinct qid, deck_id, unnest({q.numbers('answer')}) as message from a)
    select qid, cast(null as integer) as slide, 'number' as kind, message from n where length(message) >= 2 and not exists (
        select 1 from runs where runs.deck_id = n.deck_id and contains(run, replace(message, ',', '')))
    union all select qid, page, 'contradiction', 'says otherwise' from a""", "chunks"))
def answer_warnings(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    answers = pages.select(F.col("doc_id").alias("qid"), "deck_id", F.concat("text", F.lit(" 48151623")).alias("answer"),
                           F.concat(num(), F.lit(" | says otherwise\n9999 | nowhere")).alias("response"))
    return gen.answer_warnings(answers, pages, gen.number_runs(pages))


@query("m6_flow_steps")
def flow_steps(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    slides = F.array(F.struct(F.col("page").alias("slide"), F.col("text").alias("text")))
    line = F.concat(num(), F.lit(" | "), head(), F.lit(" | detail words | "), head(), F.lit(" | so | same thing\n777 | moved step | - | - | odd link | -\n"),
                    num(), F.lit(" | bad 48151623 | x\n3 | never reached"))
    flow = gen.flow_steps(pages.select("doc_id", F.lit("q").alias("question"), F.lit("fact").alias("qtype"), slides.alias("slides"), line.alias("response")), LATIN)
    return flow.select("doc_id", "status", F.size("steps").alias("n_steps"), F.array_join(F.col("steps.link"), ",").alias("links"))


@query("m7_cut_at_unsupported", rf"""
    with d as (select doc_id as id, text, regexp_replace(text, '[0-4]', '', 'g') as source from documents),
    s as (select id, source, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
        lambda x: {q.strip(r"regexp_replace(x, '[*][*]|__|`', '', 'g')")}), lambda x: x <> '') as said from d),
    b as (select id, said, list_position(list_transform(said, lambda x: {q.numbers_ok_by_name('x', 'source', "''")}), false) as bad,
        len(said) = 0 or (len(said) = 1 and regexp_replace(said[1], '^["'' .]+|["'' .]+$', '', 'g') = {q.quote(LATIN.none_word)}) as nothing from s)
    select id, case when nothing then 'no_answer' when bad > 0 then 'blocked' else 'ok' end as status,
        case when nothing then 0 when bad > 0 then length(array_to_string(said[1:bad - 1], ' ')) else length(array_to_string(said, ' ')) end as n_shown from b""")
def cut_at_unsupported(spark, sf_dir):
    answers = t.documents(spark, sf_dir).select("id", F.col("text").alias("response"), F.regexp_replace("text", "[0-4]", "").alias("source"),
                                                F.lit("").alias("question"))
    return gen.cut_at_unsupported(answers).select("id", "status", F.length("shown").alias("n_shown"))


@query("m8_refined_blocks", q.with_views(f"""select deck_id, page, length(b) as n_chars from (select deck_id, page, text, {q.strip('text')}
    || case when page % 4 = 0 then ' 48151623' else '' end as b from chunks) where b <> '' and {q.numbers_ok('b', 'text')}""", "chunks"))
def refined_blocks(spark, sf_dir):
    body = F.concat(F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.when(F.col("page") % 4 == 0, " 48151623").otherwise(""))
    return gen.refined_blocks(_responses(spark, sf_dir, F.concat(F.lit("=== "), num(), F.lit("\n"), body, F.lit("\n"))), _pages(spark, sf_dir)).select(
        "deck_id", "page", F.length("text").alias("n_chars"))


def _page_graph(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    line = F.lit("## 슬라이드\n1 | 문제 | first\n2 | odd | second\n999 | 문제 | gone\n## 연결\n1 | 2 | 근거 | because\n2 | 2 | 근거 | self\n"
                 "3 | 1 | other | 48151623 times\n## 줄거리\n1. it starts | 1, 2, 99\nnumber 48151623 | 1")
    responses = pages.where(F.col("page") == 1).select("deck_id", line.alias("response"))
    return gen.page_graph(responses, pages, gen.number_runs(pages), KOREAN.roles, KOREAN.page_relations, "소개", "이어짐")


@query("m9_page_graph_nodes", q.with_views("""select deck_id, page, case page when 1 then '문제' else '소개' end as role from chunks""", "chunks"))
def page_graph_nodes(spark, sf_dir):
    return _page_graph(spark, sf_dir)[0].select("deck_id", "page", "role")


@query("m9_page_graph_edges", q.with_views("""select deck_id, 1 as src, 2 as dst, '근거' as relation, 'because' as why, 1 as ord from chunks where page = 1
    union all select deck_id, 3, 1, '이어짐', '', 2 from chunks where page = 1""", "chunks"))
def page_graph_edges(spark, sf_dir):
    return _page_graph(spark, sf_dir)[1]


@query("m9_page_graph_story", q.with_views("select deck_id, 'it starts' as text, '1,2' as pages from chunks where page = 1", "chunks"))
def page_graph_story(spark, sf_dir):
    return _page_graph(spark, sf_dir)[2].select("deck_id", "text", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def _knowledge_graph(spark, sf_dir):
    chunks = gen.knowledge_batches(_pages(spark, sf_dir).select("deck_id", F.col("doc_id").alias("id"), F.col("page").alias("ord")), 10)
    line = F.lit("조각 | 1 | first | A\n조각 | 2 | second | B\n조각 | 99 | none | C\n관계 | 1 | 2 | 근거 | since\n관계 | 2 | 2 | 근거 | self\n관계 | 2 | 1 | 이상 | odd")
    responses = chunks.select("deck_id", "batch").distinct().withColumn("response", line)
    return gen.knowledge_graph(responses, chunks, KOREAN.knowledge_relations)


@query("m10_knowledge_graph_nodes", q.with_views("""select deck_id, doc_id as id, case (page - 1) % 10 when 0 then 'first' else 'second' end as name,
    case (page - 1) % 10 when 0 then 'A' else 'B' end as topic from chunks where (page - 1) % 10 < 2""", "chunks"))
def knowledge_graph_nodes(spark, sf_dir):
    return _knowledge_graph(spark, sf_dir)[0]


@query("m10_knowledge_graph_edges", q.with_views("""select a.deck_id, a.doc_id as src, b.doc_id as dst, '근거' as relation, 'since' as why
    from chunks a join chunks b on a.deck_id = b.deck_id and b.page = a.page + 1 where (a.page - 1) % 10 = 0""", "chunks"))
def knowledge_graph_edges(spark, sf_dir):
    return _knowledge_graph(spark, sf_dir)[1].drop("ord")


@query("m10_topic_order", q.with_views("""select deck_id, topic, cast(row_number() over (partition by deck_id order by first) as integer) as place from (
    select deck_id, topic, min(ord) as first from (
        select deck_id, case when page % 10 < 5 then 'T' || (page // 20) else 'A' end as topic, page as ord from chunks) group by 1, 2)""", "chunks"))
def topic_order(spark, sf_dir):
    """Every chunk of a batch named by its own line, topics in turn."""
    pages = _pages(spark, sf_dir)
    chunks = gen.knowledge_batches(pages.select("deck_id", F.col("doc_id").alias("id"), F.col("page").alias("ord")), 10)
    topic = F.when(F.col("page") % 10 < 5, F.concat(F.lit("T"), F.floor(F.col("page") / 20).cast("string"))).otherwise("A")
    lines = chunks.join(pages.select("deck_id", F.col("doc_id").alias("id"), "page"), ["deck_id", "id"]).select(
        "deck_id", "batch", F.concat(F.lit("조각 | "), F.col("number").cast("string"), F.lit(" | name | "), topic).alias("line"), "number")
    responses = lines.groupBy("deck_id", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("response"))
    return gen.topic_order(gen.knowledge_graph(responses, chunks, KOREAN.knowledge_relations)[2])


@query("m11_note_lines", q.with_views(f"""
    with d as (select deck_id || '#' || page as deck_id, page, {q.strip(HEAD_SQL)} as h,
        len(list_filter(regexp_extract_all({q.squeeze('text')}, '[0-9][0-9.]*'), lambda r: contains(r, '48151623'))) > 0 as backed from chunks)
    select deck_id, 0 as pos, page, 'explain' as kind, false as said_known, '' as new_numbers from d where h <> ''
    union all select deck_id, 1, null, case when backed then 'explain' else 'fact' end, false, case when backed then '' else '48151623' end from d
    union all select deck_id, 2, page, 'explain', true, '' from d""", "chunks"))
def note_lines(spark, sf_dir):
    pages = _alone(_pages(spark, sf_dir))
    line = F.concat(num(), F.lit(" | explain | "), head(), F.lit("\n0 | odd | has 48151623 inside\n"), num(), F.lit(" | known | \"said before\"\nbroken line"))
    parsed = gen.parse_note_lines(_alone(_responses(spark, sf_dir, line)))
    return gen.classify_notes(parsed, pages, gen.number_runs(pages)).select("deck_id", "pos", "page", "kind", "said_known", F.array_join("new_numbers", ",").alias("new_numbers"))


@query("m12_approved_cards", q.with_views("""select deck_id, 'why' as core_id, 'edited' as source, 2 as n_steps from chunks group by 1""", "chunks"))
def approved_cards(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    step = lambda text: F.struct(F.lit(text).alias("text"), F.col("page").alias("slide"))
    requests = pages.select("deck_id", "page", F.when(F.col("page") == 3, "unknown").otherwise("why").alias("core_id"),
                            F.when(F.col("page") == 1, F.array(step("  "))).otherwise(F.array(step(" one "), step(""), step("two"))).alias("steps"),
                            F.lit(True).alias("edited"), F.lit("").alias("source"), F.col("page").alias("at"))
    cards = gen.approve_cards(requests, KINDS)
    stored = stores.upsert(cards.limit(0), cards, ["deck_id", "core_id"])
    return stored.select("deck_id", "core_id", "source", F.size("steps").alias("n_steps"))


@query("m13_prompt_blocks", q.with_views("""select deck_id, cast((page - 1) // 8 as integer) as batch, md5(string_agg('=== ' || page || chr(10) || text, chr(10) || chr(10) order by page)) as digest
    from chunks group by 1, 2""", "chunks"))
def prompt_blocks(spark, sf_dir):
    return gen.prompt_blocks(_pages(spark, sf_dir).select("deck_id", "page", "text")).select("deck_id", "batch", F.md5("block").alias("digest"))


@query("m13_knowledge_batches", q.with_views("select doc_id as id, cast((page - 1) // 80 as integer) as batch, cast((page - 1) % 80 + 1 as integer) as number from chunks", "chunks"))
def knowledge_batches(spark, sf_dir):
    return gen.knowledge_batches(_pages(spark, sf_dir).select("deck_id", F.col("doc_id").alias("id"), F.col("page").alias("ord"))).select("id", "batch", "number")
