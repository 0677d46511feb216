"""Relation graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..plans.ranking import top_n
from ..sources import tables as t
from . import sql as q
from .registry import query


def _seeds(spark, sf_dir):
    """Three order nodes per question, taken from the order table."""
    orders = t.table(spark, sf_dir, "orders")
    picked = orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("node"))
    return top_n(picked, ["qid"], ["node"], 3)


SEEDS = """seeds as (select * from (select o_custkey as qid, o_orderkey as node, cast(row_number() over (partition by o_custkey order by o_orderkey) as integer) as rank from orders) where rank <= 3),
    bw as (select src as node, dst as other, relation, ord from edges union all select dst, src, relation, ord from edges)"""


@query("x1_page_neighbours", q.with_views(f"""with {SEEDS},
    f as (select s.qid, b.other, min(s.rank * 100000000000000000 + b.ord) as pos from seeds s join bw b using (node)
        where not exists (select 1 from seeds x where x.qid = s.qid and x.node = b.other) group by 1, 2)
    select qid, other, place from (select *, cast(row_number() over (partition by qid order by pos) as integer) as place from f) where place <= 10""", "edges"))
def page_neighbours(spark, sf_dir):
    return gr.page_neighbours(t.edges(spark, sf_dir), _seeds(spark, sf_dir), 10).select("qid", "other", "place")


@query("x2_chunk_neighbours", q.with_views(f"""with {SEEDS}
    select s.qid, b.other, min_by(b.relation, b.ord) as relation from seeds s join bw b using (node) where b.relation <> 'R'
        and not exists (select 1 from seeds x where x.qid = s.qid and x.node = b.other) group by 1, 2""", "edges"))
def chunk_neighbours(spark, sf_dir):
    return gr.chunk_neighbours(t.edges(spark, sf_dir), _seeds(spark, sf_dir)).select("qid", "other", "relation")


@query("x3_same_pairs", q.with_views("select distinct a, b from (select src as a, dst as b from edges where relation = 'R' union all select dst, src from edges where relation = 'R')", "edges"))
def same_pairs(spark, sf_dir):
    return gr.same_pairs(t.edges(spark, sf_dir))


@query("x4_degree_cap")
def degree_cap(spark, sf_dir):
    return gr.cap_degrees(t.edges(spark, sf_dir)).select("src", "dst", "ord")


@query("x4_degree_cap_by_graph", """
    with recursive e as (select l_suppkey as deck_id, l_partkey % 40 as src, l_orderkey % 60 + 1000000000 as dst, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as ord,
        row_number() over (partition by l_suppkey order by (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) as i from lineitem),
    r as (select distinct deck_id, cast(0 as bigint) as i, cast([] as bigint[]) as ends, cast(null as bigint) as ord from e
          union all select deck_id, i + 1, case when kept then list_concat(ends, [src, dst]) else ends end, case when kept then ord end from (
              select r.deck_id, r.i, r.ends, e.src, e.dst, e.ord, len(list_filter(r.ends, lambda x: x = e.src)) < 4 and len(list_filter(r.ends, lambda x: x = e.dst)) < 8 as kept
              from r join e on e.deck_id = r.deck_id and e.i = r.i + 1))
    select deck_id, ord from r where ord is not null""")
def degree_cap_by_graph(spark, sf_dir):
    """A graph of its own for every supplier, between classes of parts and of orders, so that most edges meet the cap."""
    edges = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("deck_id"), (F.col("l_partkey") % 40).alias("src"), (F.col("l_orderkey") % 60 + 1_000_000_000).alias("dst"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("ord"))
    return gr.cap_degrees(edges, key=["deck_id"]).select("deck_id", "ord").where("ord is not null")


@query("x5_graph_coverage", q.with_views("""select deck_id, round(avg(case when doc_id % 4 <> 0 then 1.0 else 0 end), 6) as coverage,
    round(avg(case when doc_id % 4 <> 0 then 1.0 else 0 end), 6) < 0.8 as rebuild from chunks group by 1""", "chunks"))
def graph_coverage(spark, sf_dir):
    docs = t.documents(spark, sf_dir)
    return gr.coverage(docs.where(F.col("id") % 4 != 0), docs)


@query("x6_page_expansion", q.with_views(f"""with {SEEDS},
    near as (select qid, other as node, row_number() over (partition by qid order by pos) as o from (select s.qid, b.other, min(s.rank * 100000000000000000 + b.ord) as pos
        from seeds s join bw b using (node) where not exists (select 1 from seeds x where x.qid = s.qid and x.node = b.other) group by 1, 2)),
    told as (select q.qid, p_partkey + 1000000000 as node, min(10 + p_partkey % 7) as o from part join (select distinct qid from seeds) q on p_partkey = q.qid group by 1, 2),
    pool as (select qid, node, min(o) as o from (select qid, node, o from near where o <= 10 union all select * from told) group by 1, 2),
    sc as (select *, round((node % 13) / 3.0, 6) as score from pool where node % 13 <> 0)
    select qid, node, score, place from (select *, cast(row_number() over (partition by qid order by score desc, o, node) as integer) as place from sc) where place <= 3""", "edges"))
def page_expansion(spark, sf_dir):
    edges, seeds = t.edges(spark, sf_dir), _seeds(spark, sf_dir)
    part = t.table(spark, sf_dir, "part")
    story = part.select((F.col("p_partkey") % 7).alias("line_id"), (F.col("p_partkey") + 1_000_000_000).alias("page"),
                        F.col("p_partkey").cast("string").alias("word"))
    asked = seeds.select("qid", F.col("qid").cast("string").alias("word")).distinct()
    near = seeds.join(gr.both_ways(edges), "node").select("qid", F.col("other").alias("node"))
    told = story.join(asked, "word").select("qid", F.col("page").alias("node"))
    scored = near.unionByName(told).distinct().select(
        "qid", "node", F.round((F.col("node") % 13) / 3.0, 6).alias("score"), (F.col("node") % 13).alias("n"))
    return gr.expand_pages(edges, story, seeds, asked, scored)


@query("x7_chunk_expansion")
def chunk_expansion(spark, sf_dir):
    edges, seeds = t.edges(spark, sf_dir), _seeds(spark, sf_dir)
    picked = seeds.select("qid", F.col("node").alias("id"), "rank")
    near = gr.chunk_neighbours(edges, seeds)
    scored = near.select("qid", F.col("other").alias("id"), (F.col("other") % 13).cast("double").alias("score"), (F.col("other") % 3).alias("n"))
    kinds = gr.both_ways(edges).select(F.col("node").alias("id")).distinct().withColumn("kind", F.when(F.col("id") % 2 == 0, "slide").otherwise("doc"))
    return gr.expand_chunks(picked, edges, scored, kinds)


@query("x8_page_enrichment", q.with_views("""
    select c.deck_id, c.page, length(substr(c.text, 1, 300)) as n_preview, coalesce(n.n, 0) as n_notes from chunks c left join (
        select 'src' || (deck_id % 20) as deck_id, page, count(*) as n from notes where kind in ('explain', 'fact') and page is not null group by 1, 2) n
        on n.deck_id = c.deck_id and n.page = c.page""", "chunks", "notes"))
def page_enrichment(spark, sf_dir):
    chunks = t.chunks(spark, sf_dir)
    spoken = t.notes(spark, sf_dir).withColumn("deck_id", F.concat(F.lit("src"), (F.col("deck_id") % 20).cast("string")))
    return gr.enrich_pages(chunks.select("deck_id", "page"), chunks, spoken).select("deck_id", "page", F.length("preview").alias("n_preview"), "n_notes")


@query("x8_chunk_enrichment", q.with_views("""select id, case when doc_id % 2 = 0 then 'n' || doc_id else substr(text, 1, 18) end as name,
    case when doc_id % 2 = 0 then 't' || (doc_id % 5) else '새로 더한 자료' end as topic from chunks""", "chunks"))
def chunk_enrichment(spark, sf_dir):
    chunks = t.chunks(spark, sf_dir)
    nodes = chunks.where(F.col("doc_id") % 2 == 0).select("deck_id", "id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"),
                                                          F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")).alias("topic"))
    return gr.enrich_chunks(chunks, nodes).select("id", "name", "topic")


@query("x8_live_edges", q.with_views("select src, dst, ord from edges where src % 3 <> 0 and dst % 3 <> 0", "edges"))
def live_edges(spark, sf_dir):
    edges = t.edges(spark, sf_dir)
    nodes = gr.both_ways(edges).select(F.col("node").alias("id")).where(F.col("id") % 3 != 0)
    return gr.live_edges(edges, nodes).select("src", "dst", "ord")


@query("x9_degrees", q.with_views("select node, count(*) as degree from (select src as node from edges union all select dst from edges where dst <> src) group by 1", "edges"))
def degrees(spark, sf_dir):
    return gr.degrees(t.edges(spark, sf_dir))


@query("x9_pages_in_need", q.with_views("""
    select node, degree from (select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by 1)
    where node % 2 = 0 and node % 5 <> 0 order by degree desc, node limit 4""", "edges"))
def pages_in_need(spark, sf_dir):
    edges = t.edges(spark, sf_dir)
    nodes = gr.both_ways(edges).select("node").distinct().withColumn("n_notes", (F.col("node") % 2).cast("int")).withColumn(
        "role", F.when(F.col("node") % 5 == 0, "intro").otherwise("method"))
    return gr.pages_in_need(nodes, edges, intro="intro").select("node", "degree")



@query("x10_explanation_gaps", q.with_views("""
    select distinct conv_id as deck_id, cast(turn + 1 as integer) as page from conversations c where length(trim(text)) > 0 and not exists (
        select 1 from notes n where n.deck_id = c.conv_id and n.page = c.turn + 1)""", "notes"))
def explanation_gaps(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("deck_id"), F.lit("slide").alias("kind"), (F.col("turn") + 1).cast("int").alias("page"))
    spoken = t.notes(spark, sf_dir).select("deck_id", F.lit("doc").alias("kind"), "page")
    return gr.explanation_gaps(turns.unionByName(spoken))


@query("x11_topic_columns", q.with_views("""select id, cast(row_number() over (partition by deck_id, kind order by case when source = 'script' then 0 else 1 end, coalesce(page, 99), ord) as integer) as place from notes""", "notes"))
def topic_columns(spark, sf_dir):
    rows = t.notes(spark, sf_dir).select("deck_id", F.col("kind").alias("topic"), "id", "page", "ord", F.when(
        F.col("source") == "script", "slide").otherwise("doc").alias("kind"))
    return gr.topic_columns(rows).select("id", "place")


@query("x11_kind_counts", q.with_views("select deck_id, kind, count(*) as n from notes where contains(text, 'en') and kind in ('explain', 'fact') group by 1, 2", "notes"))
def kind_counts(spark, sf_dir):
    rows = t.notes(spark, sf_dir).withColumn("name", F.lit(""))
    return gr.kind_counts(gr.filter_chunks(rows, "en", ["explain", "fact"]))
