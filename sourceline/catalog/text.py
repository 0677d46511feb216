"""Text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import highlight as hl
from ..functions import text as tx
from ..functions.profiles import LATIN
from ..functions.spoken import clean_question
from ..operators.guards import highlight_words
from ..plans.ranking import first_per_group
from ..sources import stores
from ..sources import tables as t
from . import sql as q
from .registry import query

MARK = "chr(10) || chr(10) || '[노트] '"


@query("t1_whitespace", rf"""select doc_id as id, md5({q.strip(r"regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) as digest
    from documents""")
def whitespace(spark, sf_dir):
    return t.documents(spark, sf_dir).select("id", F.md5(tx.tidy_whitespace(F.col("text"))).alias("digest"))


def _assembled(spark, sf_dir):
    pages = t.chunks(spark, sf_dir).select(
        "deck_id", "page", F.col("text").alias("body"),
        F.when(F.col("page") % 3 == 0, F.concat(F.lit("note "), F.col("page").cast("string"))).otherwise("").alias("notes"))
    return stores.assemble_chunks(pages)


ASSEMBLED = f"""select deck_id || '#p' || page as id, deck_id || '.pdf' as source, page,
    text || case when page % 3 = 0 then {MARK} || 'note ' || page else '' end as full_text from chunks"""


@query("t2_chunk_assembly", q.with_views(
    f"select id, source, page, length(full_text) as n_chars, md5(full_text) as digest from ({ASSEMBLED})", "chunks"))
def chunk_assembly(spark, sf_dir):
    return _assembled(spark, sf_dir).select("id", "source", "page", "n_chars", F.md5("text").alias("digest"))


@query("t3_split_notes", q.with_views(
    f"select id, length(split_part(full_text, {MARK}, 1)) as n_body, split_part(full_text, {MARK}, 2) as notes from ({ASSEMBLED})",
    "chunks"))
def split_notes(spark, sf_dir):
    return _assembled(spark, sf_dir).select(
        "id", F.length(tx.body_part(F.col("text"))).alias("n_body"), tx.notes_part(F.col("text")).alias("notes"))


@query("t4_missing_spaces", """
    with p as (select doc_id as id, len(regexp_extract_all(squashed, '[a-z]')) as letters, string_split(squashed, ' ') as w
               from (select doc_id, case when doc_id % 3 = 0 then replace(text, ' ', '') else text end as squashed from documents))
    select id, letters >= 30 and len(list_filter(range(1, len(w)), lambda i: regexp_matches(w[i], '[a-z]$')
        and regexp_matches(w[i + 1], '^[a-z]'))) / letters < 0.05 as misses_spaces from p""")
def missing_spaces(spark, sf_dir):
    squashed = F.when(F.col("id") % 3 == 0, F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text"))
    return t.documents(spark, sf_dir).select("id", tx.misses_spaces(squashed, "a-z").alias("misses_spaces"))


@query("t5_units", rf"""select doc_id as id, md5(regexp_replace(text || ' 95 % of 10 곳', '([0-9])\s+({tx.UNIT})', '\1\2', 'g')) as digest
    from documents""")
def units(spark, sf_dir):
    return t.documents(spark, sf_dir).select("id", F.md5(tx.attach_units(
        F.concat("text", F.lit(" 95 % of 10 곳")))).alias("digest"))


@query("t6_join_wrapped", rf"""
    with recursive d as (select doc_id as id, string_split(replace(text, ', ', ',' || chr(10)), chr(10)) as ls from documents),
    r as (select id, 1 as i, '' as done, ls[1] as open from d
          union all select id, i + 1, case when joins then done else done || open || chr(10) end, case when joins then held || ' ' || nxt else raw end from (
            select *, nxt <> '' and not regexp_matches(nxt, {q.quote(tx.BULLET)})
                and length(regexp_replace(nxt, '[\s\p{{Z}}]', '', 'g')) >= case when ends_with(held, ',') then {tx.MIN_NEXT_AFTER_COMMA} else {tx.MIN_NEXT} end
                and length(open) + length(nxt) < {tx.MAX_JOINED} and (ends_with(held, ',') or regexp_matches(held, {q.quote(LATIN.open_end)})) as joins
            from (select r.*, ls[i + 1] as raw, {q.strip('ls[i + 1]')} as nxt, regexp_replace(open, '[\s\p{{Z}}]+$', '') as held
                  from r join d using (id) where i < len(ls))))
    select id, md5(done || open) as digest from r join d using (id) where i = len(ls)""")
def join_wrapped(spark, sf_dir):
    return t.documents(spark, sf_dir).select("id", F.md5(tx.join_wrapped(
        F.regexp_replace("text", ", ", ",\n"), LATIN.open_end)).alias("digest"))


@query("t7_candidate_lines", q.with_views("select id, idx, md5(line) as digest from lines", "lines"))
def candidate_lines(spark, sf_dir):
    return t.documents(spark, sf_dir).select("id", F.posexplode(tx.candidate_lines(F.col("text"))).alias("idx", "c")).select(
        "id", "idx", F.md5("c.line").alias("digest"))


MARKED = "'## Head' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- ') || chr(10) || '04 the numbered line stands here'"


@query("t8_refined_lines", rf"""
    select id, pos, md5(line) as digest from (select id, i - 1 as pos, regexp_replace(
        {q.strip(r"regexp_replace(ls[i], '^\s*(?:#+\s*|[-•*]\s*)', '')")}, '^(?:0[0-9]|[0-9]{{1,2}})[.)]?\s+(.{{12,}})$', '\1') as line
        from (select id, ls, unnest(range(1, len(ls) + 1)) as i from (
            select doc_id as id, string_split({MARKED}, chr(10)) as ls from documents))) where length(line) > 6""")
def refined_lines(spark, sf_dir):
    marked = F.concat(F.lit("## Head\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")),
                      F.lit("\n04 the numbered line stands here"))
    return t.documents(spark, sf_dir).select("id", F.explode(tx.refined_lines(marked)).alias("c")).select(
        "id", "c.pos", F.md5("c.line").alias("digest"))


@query("t10_lexical_tokens", f"""select doc_id as id, len({q.tokens('text')}) as n,
    md5(array_to_string({q.tokens('text')}, ' ')) as digest from documents""")
def lexical_tokens(spark, sf_dir):
    tokens = tx.lexical_tokens(F.col("text"))
    return t.documents(spark, sf_dir).select("id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query("t11_content_words", f"""select doc_id as id, len({q.words('text')}) as n,
    md5(array_to_string({q.words('text')}, ' ')) as digest from documents""")
def content_words(spark, sf_dir):
    words = tx.content_words(F.col("text"))
    return t.documents(spark, sf_dir).select("id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("digest"))


@query("t12_spoken_cleaning")
def spoken_cleaning(spark, sf_dir):
    return t.live_questions(spark, sf_dir).select("qid", clean_question(F.col("question"), LATIN).alias("cleaned"))


@query("t13_first_readable_line", rf"""
    with l as (select doc_id as id, {q.lines('text')} as ls from documents),
    f as (select id, ls, list_filter(ls, lambda l: len(regexp_extract_all(l, '\p{{L}}')) >= 2 and not (
        len(list_distinct(regexp_extract_all(l, '\p{{L}}'))) / len(regexp_extract_all(l, '\p{{L}}')) < 0.5
        or list_max(list_transform(list_distinct(regexp_extract_all(l, '\p{{L}}')),
            lambda c: len(list_filter(regexp_extract_all(l, '\p{{L}}'), lambda x: x = c)))) / len(regexp_extract_all(l, '\p{{L}}')) > 0.4)) as good from l)
    select id, substr(coalesce(good[1], ls[1], ''), 1, 24) as title from f""")
def first_readable_line(spark, sf_dir):
    return t.documents(spark, sf_dir).select("id", tx.first_readable_line(
        F.col("text"), r"\p{L}", r"\p{L}", 24).alias("title"))


@query("t14_budget_parts", rf"""
    with recursive d as (select doc_id as id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n') as ps from documents),
    r as (select id, 0 as i, 0 as cur, 0 as part, false as solid, cast(null as bigint) as closed from d
          union all select id, i + 1, case when shut then n + 2 else cur + n + 2 end, part + shut::int, regexp_matches(p, '[^\s\p{{Z}}]') or (solid and not shut),
                 case when shut then cur end from (
              select *, length(p) as n, cur + length(p) > {tx.PART_MAX} and cur > 0 as shut from (select r.*, ps[i + 1] as p from r join d using (id) where i < len(ps))))
    select id, cast(part - 1 as integer) as part, cast(closed as integer) as n_chars from r where closed is not null
    union all select id, part, cast(cur as integer) from r join d using (id) where i = len(ps) and solid""")
def budget_parts(spark, sf_dir):
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return t.documents(spark, sf_dir).select("id", F.posexplode(tx.budget_parts(spaced)).alias("part", "text")).select(
        "id", "part", F.length("text").alias("n_chars"))


SECTIONED = "'# Intro' || chr(10) || text || chr(10) || chr(10) || '1. Next part' || chr(10) || 'tail of ' || doc_id || chr(10) || '## Empty'"


@query("t15_sections", rf"""
    with l as (select id, i, ls[i] as line from (select id, ls, unnest(range(1, len(ls) + 1)) as i from (
            select doc_id as id, string_split({SECTIONED}, chr(10)) as ls from documents))),
    k as (select *, not regexp_matches(line, '[^\s\p{{Z}}]') as blank,
            regexp_matches(line, {q.quote(tx.HEADING_LINE)}) and length({q.strip('line')}) <= 50 as head from l),
    g as (select *, sum(case when blank or head then 1 else 0 end) over (partition by id order by i) as grp,
            last_value(case when head and not blank then {q.strip("regexp_replace(" + q.strip('line') + ", '^#+', '')")} end ignore nulls)
                over (partition by id order by i rows unbounded preceding) as heading from k)
    select id, heading, md5(string_agg({q.strip('line')}, ' ' order by i)) as digest from g where not blank and not head
    group by id, grp, heading""")
def sections(spark, sf_dir):
    built = F.concat(F.lit("# Intro\n"), F.col("text"), F.lit("\n\n1. Next part\ntail of "), F.col("id").cast("string"), F.lit("\n## Empty"))
    return t.documents(spark, sf_dir).select("id", F.explode(tx.sections(built)).alias("s")).select(
        "id", "s.heading", F.md5("s.body").alias("digest"))


@query("t16_bigrams", q.with_views(f"""select id, len(g) as n, md5(array_to_string(list_sort(g), '|')) as digest
    from (select id, {q.bigrams('text')} as g from notes)""", "notes"))
def bigrams(spark, sf_dir):
    grams = tx.bigrams(F.col("text"))
    return t.notes(spark, sf_dir).select("id", F.size(grams).alias("n"),
                                         F.md5(F.array_join(F.array_sort(grams), "|")).alias("digest"))


@query("t17_content_ids", q.with_views("""
    select deck_id, id, min(ord) as ord from (select deck_id, ord,
        substr(sha1(kind || '|' || coalesce(cast(page as varchar), 'None') || '|' || text), 1, 10) as id from notes)
    group by 1, 2""", "notes"))
def content_ids(spark, sf_dir):
    named = t.notes(spark, sf_dir).withColumn("id", tx.content_id(F.col("kind"), F.col("page"), F.col("text")))
    return first_per_group(named, ["deck_id", "id"], ["ord"]).select("deck_id", "id", "ord")


@query("t18_page_references", r"""with d as (select doc_id as id, '12번 슬라이드, p.3 and 10번 ' || text || ' 0번 슬라이드' as x from documents)
    select id, regexp_replace(regexp_replace(x, '[0-9]+\s*번\s*(?:슬라이드|장)', '', 'g'), '(?:p\.?\s*|슬라이드\s*)[0-9]+', '', 'g') as without_refs,
        regexp_replace(regexp_replace(x, '(^|[^0-9])0\s*번(?:\s*(?:슬라이드|장))?', '\1보강 자료', 'g'), '슬라이드\s*0([^0-9]|$)', '보강 자료\1', 'g') as spoken from d""")
def page_references(spark, sf_dir):
    text = F.concat(F.lit("12번 슬라이드, p.3 and 10번 "), F.col("text"), F.lit(" 0번 슬라이드"))
    return t.documents(spark, sf_dir).select("id", tx.drop_page_refs(text).alias("without_refs"),
                                             tx.name_page_zero(text).alias("spoken"))


@query("t19_messages", """
    with m as (select conv_id * 16777216 + turn as qid, case turn % 4
        when 0 then cast(json_object('text', text) as varchar)
        when 1 then cast(json_object('type', 'stt.partial', 'text', text, 'presentation_id', 'd' || conv_id) as varchar)
        when 2 then '{"type": ' || text else '  ' || text || ' ' end as raw from conversations)
    select qid, case when json_valid(trim(raw)) and trim(raw)[1] = '{' then coalesce(json_extract_string(raw, '$.type'), 'stt.final') else 'stt.final' end as type,
        md5(case when json_valid(trim(raw)) and trim(raw)[1] = '{' then json_extract_string(raw, '$.text') else trim(raw) end) as digest,
        case when json_valid(trim(raw)) and trim(raw)[1] = '{' then json_extract_string(raw, '$.presentation_id') end as deck_id from m""")
def messages(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations")
    which = F.col("turn") % 4
    raw = (F.when(which == 0, F.to_json(F.struct("text")))
           .when(which == 1, F.to_json(F.struct(F.lit("stt.partial").alias("type"), "text", F.concat(
               F.lit("d"), F.col("conv_id").cast("string")).alias("presentation_id"))))
           .when(which == 2, F.concat(F.lit('{"type": '), "text")).otherwise(F.concat(F.lit("  "), "text", F.lit(" "))))
    return turns.select((F.col("conv_id") * 16777216 + F.col("turn")).alias("qid"), tx.parse_message(raw).alias("m")).select(
        "qid", "m.type", F.md5("m.text").alias("digest"), "m.deck_id")


@query("t20_highlight_spans")
def highlight_spans(spark, sf_dir):
    """Every place of the phrases that are highlighted (three at most, by their own rule) and of numbers with units."""
    words = highlight_words(tx.content_words(F.col("text")), F.col("text"), F.lit(""))
    docs = t.documents(spark, sf_dir).select("id", "text", words.alias("words"))
    return docs.select("id", hl.word_and_number_spans(F.col("text"), F.col("words")).alias("s")).select(
        "id", F.posexplode("s").alias("n", "span")).select("id", "n", "span.start", "span.end")


@query("t20_literal_spans", rf"""
    with d as (select doc_id as id, text, list_distinct(regexp_extract_all(text, '[a-z]{{4}}'))as ws0 from documents),
    w as (select id, text, case when len(regexp_extract_all(text, '[a-z]{{4}}')) > 0 then regexp_extract(text, '[a-z]{{4}}') end as word from d),
    p as (select id, word, string_split(text, word) as ps from w where word is not null)
    select id, cast(start as integer) as start, cast(start + length(word) as integer) as "end" from (
        select id, word, list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(word) as start
        from (select id, word, ps, unnest(range(1, len(ps))) as i from p))""")
def literal_spans(spark, sf_dir):
    word = F.regexp_extract("text", "[a-z]{4}", 0)
    docs = t.documents(spark, sf_dir).select("id", "text", F.array(word).alias("words"))
    return docs.select("id", F.explode(hl.literal_spans(F.col("text"), F.col("words"))).alias("s")).select("id", "s.*")
