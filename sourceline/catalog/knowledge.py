"""Knowledge chunks and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import HEADING_LINE
from ..functions.text import sections as text_sections
from ..operators import knowledge as kb
from ..operators import notes as nt
from ..sources import tables as t
from . import sql as q
from .registry import query


@query("k1_section_chunks")
def section_chunks(spark, sf_dir):
    refined = t.chunks(spark, sf_dir).select("deck_id", "page", F.concat(
        F.lit("# Title\n## Part one\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")), F.lit("\n## Part two")).alias("text"))
    return kb.section_chunks(refined).select("deck_id", "page", "part", F.length("text").alias("n_chars"))


@query("k2_raw_chunks", q.with_views(f"""
    select deck_id, page, cast(s / 6 as integer) as part, md5(case when s > 0 then ls[1] || ' / ' else '' end || array_to_string(ls[s + 1:s + 6], ' / ')) as digest
    from (select deck_id, page, ls, unnest(range(0, len(ls), 6)) as s from (select *, {q.lines('text')} as ls from chunks))""", "chunks"))
def raw_chunks(spark, sf_dir):
    return kb.raw_chunks(t.chunks(spark, sf_dir)).select("deck_id", "page", "part", F.md5("text").alias("digest"))


NOTE_CHUNKS = """g as (select *, coalesce(para, -1) as pg, row_number() over (partition by deck_id, source, coalesce(para, -1) order by ord) - 1 as i,
        count(*) over (partition by deck_id, source, coalesce(para, -1)) as n from notes),
    sp as (select deck_id, source, pg, n, section, unnest(case when pg < 0 then range(0, greatest(n - 1, 1)) when n <= 5 then [0] else range(0, n - 1, 2) end) as s from g where i = 0),
    r as (select sp.*, g.ord, g.text, g.page, g.i from sp join g using (deck_id, source, pg) where case when sp.pg < 0 then g.i between s and s + 1 when sp.n <= 5 then true else g.i between s and s + 2 end),
    pm as (select deck_id, source, pg, s, page from (select *, row_number() over (partition by deck_id, source, pg, s order by c desc, f) as k from (
        select deck_id, source, pg, s, page, count(*) as c, min(i) as f from r where page is not null group by all)) where k = 1),
    nc as (select deck_id, source as kind, pm.page, min(ord) as ord, case when pg >= 0 then section || ' / ' else '' end || string_agg(text, ' ' order by ord) as text
        from r left join pm using (deck_id, source, pg, s) group by deck_id, source, pg, s, section, pm.page)"""


@query("k3_note_chunks", q.with_views(f"with {NOTE_CHUNKS} select deck_id, kind, page, ord, md5(text) as digest from nc", "notes"))
def note_chunks(spark, sf_dir):
    return kb.note_chunks(t.notes(spark, sf_dir)).select("deck_id", "kind", "page", "ord", F.md5("text").alias("digest"))


@query("k4_knowledge_build", q.with_views(f"""with {NOTE_CHUNKS},
    pc as (select conv_id as deck_id, 'slide' as kind, cast(turn as integer) as page, case when s > 0 then ls[1] || ' / ' else '' end || array_to_string(ls[s + 1:s + 6], ' / ') as text
        from (select conv_id, turn, ls, unnest(range(0, len(ls), 6)) as s from (select *, {q.lines('text')} as ls from conversations))),
    u as (select deck_id, kind, page, text from pc union all select deck_id, kind, page, text from nc)
    select deck_id, substr(sha1(kind || '|' || coalesce(cast(page as varchar), 'None') || '|' || text), 1, 10) as id, any_value(kind) as kind, any_value(page) as page from u group by 1, 2""", "notes"))
def knowledge_build(spark, sf_dir):
    pages = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("deck_id"), F.col("turn").cast("int").alias("page"), "text")
    return kb.build_knowledge(pages, t.notes(spark, sf_dir)).select("deck_id", "id", "kind", "page")


DUP = f"""gr as (select deck_id, id, ord, text, {q.bigrams('text')} as g from notes),
    sim as (select a.deck_id, a.id, a.ord, b.id as bid, b.ord as bord from gr a join gr b on a.deck_id = b.deck_id and len(a.g) > 0 and len(b.g) > 0
        and len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) >= 0.6)"""


@query("n1_near_duplicates", q.with_views(f"""with {DUP}, f as (select deck_id, id, min_by(bid, bord) as first, min(bord) as fo, any_value(ord) as ord from sim group by 1, 2)
    select n.id, coalesce(f.fo < n.ord, false) as dup, case when f.fo < n.ord then f.first end as similar_to from notes n left join f using (deck_id, id)""", "notes"))
def near_duplicates(spark, sf_dir):
    notes = t.notes(spark, sf_dir)
    return nt.first_similar(notes.select("deck_id", "id", "text", "ord"), notes, earlier_only=True).select("id", "dup", "similar_to")


@query("n2_note_insert", q.with_views(f"""
    with recursive seq as (select deck_id, id, text, ord < 2 * 16777216 as stored, {q.bigrams('text')} as g,
            row_number() over (partition by deck_id order by ord >= 2 * 16777216, ord) as i from notes where kind in ('repeat', 'explain', 'fact') or ord < 2 * 16777216),
    r as (select deck_id, cast(0 as bigint) as i, cast([] as varchar[]) as ids, cast([] as varchar[]) as texts, cast([] as varchar[][]) as grams,
            cast([] as boolean[]) as added, cast([] as boolean[]) as changed from seq where i = 1
          union all select deck_id, i + 1, case when fresh then list_append(ids, id) else ids end,
            case when fresh then list_append(texts, text) when longer then list_concat(list_append(texts[1:twin - 1], text), texts[twin + 1:]) else texts end,
            case when fresh then list_append(grams, g) when longer then list_concat(list_append(grams[1:twin - 1], g), grams[twin + 1:]) else grams end,
            case when fresh then list_append(added, not stored) else added end,
            case when fresh then list_append(changed, false) when longer then list_concat(list_append(changed[1:twin - 1], true), changed[twin + 1:]) else changed end
          from (select *, twin is null or stored as fresh, twin is not null and length(text) > length(texts[twin]) as longer from (
            select r.*, s.id, s.text, s.stored, s.g, list_position(list_transform(r.grams, lambda k: len(k) > 0 and len(s.g) > 0
                and len(list_intersect(k, s.g)) / least(len(k), len(s.g)) >= 0.6), true) as twin
            from r join seq s on s.deck_id = r.deck_id and s.i = r.i + 1))),
    last as (select * from r where i = (select max(i) from seq s where s.deck_id = r.deck_id))
    select unnest(ids) as id, unnest(added) as added, unnest(changed) as changed, unnest(list_transform(texts, lambda x: length(x))) as n_chars from last""", "notes"))
def note_insert(spark, sf_dir):
    notes = t.notes(spark, sf_dir)
    return nt.insert_notes(notes.where(F.col("ord") < 2 * 16777216), notes.where(F.col("ord") >= 2 * 16777216)).select("id", "added", "changed", F.length("text").alias("n_chars"))


@query("n3_delete", q.with_views("select id from notes where not (deck_id % 2 = 0 and ord % 3 = 0)", "notes"))
def delete_notes(spark, sf_dir):
    notes = t.notes(spark, sf_dir)
    return nt.delete_notes(notes, notes.where((F.col("deck_id") % 2 == 0) & (F.col("ord") % 3 == 0))).select("id")


@query("n3_removed_counts", q.with_views("select deck_id, count(*) as n_removed from notes where deck_id % 2 = 0 and ord % 3 = 0 group by 1", "notes"))
def removed_counts(spark, sf_dir):
    notes = t.notes(spark, sf_dir)
    return nt.removed_counts(notes, notes.where((F.col("deck_id") % 2 == 0) & (F.col("ord") % 3 == 0)))


@query("n4_page_notes", q.with_views("select id, page from notes where kind in ('explain', 'fact') and page is not null", "notes"))
def page_notes(spark, sf_dir):
    return nt.page_notes(t.notes(spark, sf_dir)).select("id", "page")


@query("n4_general_notes", q.with_views("select id from notes where kind in ('explain', 'fact') and page is null", "notes"))
def general_notes(spark, sf_dir):
    return nt.general_notes(t.notes(spark, sf_dir)).select("id")


def _bare(x):
    return rf"""regexp_replace({x}, '[\s\p{{Z}}#*>\-|`"''.,()]', '', 'g')"""


@query("n5_section_attachment", q.with_views(rf"""
    with l as (select source_id, i, ls[i] as line from (select source_id, ls, unnest(range(1, len(ls) + 1)) as i from (
            select conv_id * 16777216 + turn as source_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)) as ls from conversations))),
    k as (select *, not regexp_matches(line, '[^\s\p{{Z}}]') as blank, regexp_matches(line, {q.quote(HEADING_LINE)}) and length({q.strip('line')}) <= 50 as head from l),
    f as (select *, coalesce(last_value(case when head and not blank then {q.strip("regexp_replace(" + q.strip('line') + ", '^#+', '')")} end ignore nulls)
            over (partition by source_id order by i rows unbounded preceding), '') as heading from k),
    sec as (select source_id, heading, {q.strip('line')} as body, row_number() over (partition by source_id order by i) - 1 as para from f where not blank and not head),
    its as (select id, deck_id * 16777216 + ord // 16777216 as source_id, text from notes),
    sh as (select i.id, s.para, s.heading, case when len(a) > 0 then round(len(list_intersect(a, b)) / len(a), 9) else 0 end as share from (
            select id, source_id, {q.bigrams(_bare('text'))} as a from its) i join (select *, {q.bigrams(_bare('body'))} as b from sec) s using (source_id)),
    best as (select * from (select *, row_number() over (partition by id order by share desc, para) as r from sh) where r = 1 and share >= 0.5)
    select i.id, cast(b.para as integer) as para, b.heading as section from its i left join best b using (id)""", "notes"))
def section_attachment(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations")
    sources = turns.select((F.col("conv_id") * 16777216 + F.col("turn")).alias("source_id"),
                           text_sections(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("sections"))
    items = t.notes(spark, sf_dir).select("id", (F.col("deck_id") * 16777216 + F.floor(F.col("ord") / 16777216)).alias("source_id"), "text")
    return nt.attach_sections(items, sources).select("id", "para", "section")


COVER = r"""
    so as (select conv_id * 16777216 + turn as part, regexp_replace(text, '[\s\p{Z}#*>\-|`"''.,()]', '', 'g') as c from conversations),
    att as (select deck_id * 16777216 + ord // 16777216 as part, cast(ord % 2 as integer) as attempt, regexp_replace(text, '[\s\p{Z}#*>\-|`"''.,()]', '', 'g') as c from notes),
    sg as (select distinct part, substr(c, cast(i as int), 2) as g from (select part, c, unnest(range(1, length(c))) as i from so)),
    ag as (select distinct part, attempt, substr(c, cast(i as int), 2) as g from (select part, attempt, c, unnest(range(1, length(c))) as i from att)),
    cv as (select a.part, a.attempt, round(coalesce(k.n, 0) / s.n, 9) as cover from (select distinct part, attempt from att) a
        join (select part, count(*) as n from sg group by 1) s using (part) left join (select part, attempt, count(*) as n from ag join sg using (part, g) group by 1, 2) k using (part, attempt))"""


def _covers(spark, sf_dir):
    sources = t.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 16777216 + F.col("turn")).alias("part"), "text")
    attempts = t.notes(spark, sf_dir).select((F.col("deck_id") * 16777216 + F.floor(F.col("ord") / 16777216)).alias("part"),
                                             (F.col("ord") % 2).cast("int").alias("attempt"), "text")
    return nt.attempt_coverage(attempts, sources)


@query("n6_attempt_coverage", q.with_views(f"with {COVER} select part, attempt, round(cover, 6) as cover from cv", "notes"))
def attempt_coverage(spark, sf_dir):
    return _covers(spark, sf_dir).withColumn("cover", F.round("cover", 6))


@query("n6_best_attempt", q.with_views(f"""with {COVER} select part, attempt, round(cover, 6) as cover from (select *, row_number() over (partition by part order by
    case when cover >= 0.6 then attempt end nulls last, cover desc, attempt) as r from cv) where r = 1""", "notes"))
def best_attempt(spark, sf_dir):
    return nt.best_attempt(_covers(spark, sf_dir)).withColumn("cover", F.round("cover", 6))


@query("n7_note_counts", q.with_views("select deck_id, page, count(*) as n_notes from notes where page is not null and kind <> 'repeat' group by 1, 2", "notes"))
def note_counts(spark, sf_dir):
    return nt.note_counts(t.notes(spark, sf_dir))


@query("n7_notes_by_page", q.with_views("""select deck_id, page, n, cast(row_number() over (partition by deck_id order by case when page = 0 then 999 else page end) as integer) as place
    from (select deck_id, coalesce(page, 0) as page, count(*) as n from notes where kind <> 'repeat' group by 1, 2)""", "notes"))
def notes_by_page(spark, sf_dir):
    return nt.notes_by_page(t.notes(spark, sf_dir))
