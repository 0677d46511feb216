"""Page and knowledge graphs as edge tables ``src, dst, relation, why, ord``.

``key`` columns (a deck id, say) separate graphs; by default all edges are one graph.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profiles import LATIN, Profile
from ..plans.materialize import stored
from ..plans.ranking import number_ordered, top_n

# ---- fixed values -------------------------------------------------------------------
MAX_LINKS = 4               # kept edges of a source; a target takes twice as many
NEIGHBOUR_LIMIT, PAGE_EXTRA, CHUNK_SEED, CHUNK_EXTRA = 10, 3, 4, 3
ENOUGH_COVERAGE = 0.8
NAME_CHARS, PREVIEW_CHARS = 18, 300
NO_TOPIC = "새로 더한 자료"
NEED_NOTES = 4
# -------------------------------------------------------------------------------------


def both_ways(edges: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """``key..., node, other, relation, ord``."""
    forth = edges.select(*key, F.col("src").alias("node"), F.col("dst").alias("other"), "relation", "ord")
    back = edges.select(*key, F.col("dst").alias("node"), F.col("src").alias("other"), "relation", "ord")
    return forth.unionByName(back)


def page_neighbours(edges: DataFrame, seeds: DataFrame, limit: int, key: Sequence[str] = ()) -> DataFrame:
    """``qid, other, place``: pages linked to a question's pages, seeds' order first, then edge
    order; no seed itself, every page once.

    ``seeds(qid, key..., node, rank)``. A hub can give a question no more than its first ``limit``
    distinct neighbours besides the question's own seeds, so adjacency is cut to ``limit`` and the most
    seeds that any question has before the join, and a hub never meets the questions with all its edges.
    """
    most = seeds.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    adjacency = both_ways(edges, key).groupBy(*key, "node", "other").agg(F.min("ord").alias("ord"))
    near = top_n(adjacency, [*key, "node"], ["ord"], limit + most, "_nth").drop("_nth")
    found = (seeds.join(near, [*key, "node"])
             .join(seeds.select("qid", F.col("node").alias("other")), ["qid", "other"], "left_anti")
             .groupBy("qid", *key, "other").agg(F.min(F.struct("rank", "ord")).alias("at")))
    return top_n(found, ["qid"], ["at.rank", "at.ord"], limit, "place").drop("at")


def chunk_neighbours(edges: DataFrame, seeds: DataFrame, key: Sequence[str] = (),
                     profile: Profile = LATIN) -> DataFrame:
    """``qid, other, relation, ord``: chunks linked to a question's chunks by any relation but
    "same content", with the relation of the first such edge."""
    linked = both_ways(edges.where(F.col("relation") != profile.same_relation), key)
    return (seeds.select("qid", *key, "node").join(linked, [*key, "node"])
            .join(seeds.select("qid", F.col("node").alias("other")), ["qid", "other"], "left_anti")
            .groupBy("qid", *key, "other").agg(F.min(F.struct("ord", "relation")).alias("first"))
            .select("qid", *key, "other", F.col("first.relation").alias("relation"), F.col("first.ord").alias("ord")))


def same_pairs(edges: DataFrame, key: Sequence[str] = (), profile: Profile = LATIN) -> DataFrame:
    same = edges.where(F.col("relation") == profile.same_relation)
    return both_ways(same, key).select(*key, F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def cap_degrees(edges: DataFrame, max_links: int = MAX_LINKS, key: Sequence[str] = ()) -> DataFrame:
    """Edges kept in order while the source has fewer than four kept edges and the target fewer
    than eight; a kept edge counts for both of its ends. ``key`` columns separate graphs.

    The rule reads as sequential, but an edge is settled as soon as its place among its ends'
    edges is certain: kept when fewer than the cap of earlier edges could still be kept, dropped
    when the cap is already kept before it. Only the first eight edges per node matter for
    either test, so a round sends eight rows per node and task however large a hub is. Each
    round settles at least the first open edge of every component; usually most of them, so the
    rounds go on until no edge is open. A round reads the open edges and, of the kept ones, those at
    nodes that still have an open edge (eight a node at most), never what earlier rounds settled; what it keeps
    decides at once which open edges are dropped.

    Defined cases: an edge without a source, target or key is left out; edges of equal ``ord`` are settled
    together; a null ``ord`` comes last.
    """
    deep, keys = 2 * max_links, list(key)
    at = F.struct(F.col("ord").isNull().alias("none"), "ord")     # a null has its place in the order of structs

    def ends(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, F.explode(F.array("src", "dst")).alias("node"), "ord")

    def cut_points(rows: DataFrame) -> DataFrame:
        """``keys..., node, fourth, eighth``: places of those ends in ``rows`` (null: fewer) of nodes with four or more."""
        first = top_n(rows, [*keys, "node"], [F.col("ord").asc_nulls_last()], deep, "_n")
        nth = lambda n: F.max(F.when(F.col("_n") == n, at))
        return first.groupBy(*keys, "node").agg(nth(max_links).alias("fourth"), nth(deep).alias("eighth")).where("fourth is not null")

    def with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
        src = cuts.select(*keys, F.col("node").alias("src"), F.col("fourth").alias("_s"))
        dst = cuts.where("eighth is not null").select(*keys, F.col("node").alias("dst"), F.col("eighth").alias("_d"))
        return rows.join(src, [*keys, "src"], "left").join(dst, [*keys, "dst"], "left")

    beyond = lambda cut: F.col(cut).isNotNull() & (at > F.col(cut))
    later = beyond("_s") | beyond("_d")
    columns = [F.col(c) for c in edges.columns]
    open_edges, taken, kept = edges.dropna(subset=[*keys, "src", "dst"]), None, edges.limit(0)
    while True:
        maybe = ends(open_edges) if taken is None else ends(open_edges).unionByName(taken)
        judged = stored(with_cuts(open_edges, cut_points(maybe)).select(*columns, (~later).alias("_kept")), "capped-edges")
        settled, rest = (judged.where(which).select(*columns) for which in ("_kept", "not _kept"))
        kept = kept.unionByName(settled)
        if rest.isEmpty():
            return kept
        both = ends(settled) if taken is None else ends(settled).unionByName(taken)
        open_edges = stored(with_cuts(rest, cut_points(both)).where(~later).select(*columns), "capped-open")
        if open_edges.isEmpty():
            return kept
        taken = stored(both.join(ends(open_edges).select(*keys, "node").distinct(), [*keys, "node"], "left_semi"), "capped-ends")


def coverage(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``deck_id, coverage, rebuild``: share of the deck's chunks the graph knows."""
    known = nodes.select("deck_id", "id").distinct().withColumn("_in", F.lit(1.0))
    return (chunks.select("deck_id", "id").join(known, ["deck_id", "id"], "left").groupBy("deck_id")
            .agg(F.round(F.avg(F.coalesce("_in", F.lit(0.0))), 6).alias("coverage"))
            .withColumn("rebuild", F.col("coverage") < ENOUGH_COVERAGE))


def expand_pages(edges: DataFrame, story: DataFrame, seeds: DataFrame, asked_words: DataFrame, scored: DataFrame,
                 key: Sequence[str] = (), extra: int = PAGE_EXTRA) -> DataFrame:
    """``qid, node, score, place``: up to three more pages for a question.

    Candidates are graph neighbours (ten) and pages of story lines that share a word with the
    question (``story(key..., line_id, page, word)``, ``asked_words(qid, key..., word)``); of
    those the best matching (``scored(qid, node, score, n)``) that match at all.
    """
    near = page_neighbours(edges, seeds, NEIGHBOUR_LIMIT, key).select(
        "qid", F.col("other").alias("node"), F.col("place").cast("bigint").alias("_ord"))
    told = (story.join(asked_words, [*key, "word"]).groupBy("qid", "page").agg(F.min("line_id").alias("_line"))
            .select("qid", F.col("page").alias("node"), (F.lit(NEIGHBOUR_LIMIT) + F.col("_line")).alias("_ord")))
    pool = (near.unionByName(told).groupBy("qid", "node").agg(F.min("_ord").alias("_ord"))
            .join(seeds.select("qid", "node"), ["qid", "node"], "left_anti"))
    hit = pool.join(scored, ["qid", "node"]).where(F.col("n") > 0)
    return top_n(hit, ["qid"], [F.col("score").desc(), "_ord", "node"], extra, "place").select(
        "qid", "node", "score", "place")


def expand_chunks(picked: DataFrame, edges: DataFrame, scored: DataFrame, kinds: DataFrame, key: Sequence[str] = (),
                  profile: Profile = LATIN) -> DataFrame:
    """``qid, id, place``: picked chunks plus up to three matching graph neighbours of the top
    four, with same-content twins reduced to one (a page chunk is preferred).

    ``picked(qid, key..., id, rank)``, ``scored(qid, id, score, n)``, ``kinds(id, kind)``. A
    question ends with eleven chunks at most; the reduction folds over that short array.
    """
    seeds = picked.where(F.col("rank") <= CHUNK_SEED).select("qid", *key, F.col("id").alias("node"))
    near = chunk_neighbours(edges, seeds, key, profile).select("qid", *key, F.col("other").alias("id"), "ord")
    ranked = top_n(near.join(scored, ["qid", "id"]).where(F.col("n") > 0), ["qid"],
                   [F.col("score").desc(), "ord"], CHUNK_EXTRA, "_r")
    # a neighbour may be among the lower picks already: it then stands twice, as it was picked twice
    pool = picked.select("qid", *key, "id", F.col("rank").cast("bigint").alias("_o")).unionByName(
        ranked.select("qid", *key, "id", (F.col("_r") + 1000).cast("bigint").alias("_o")))
    twins = same_pairs(edges, key, profile).select(*key, F.col("a").alias("id"), F.col("b").alias("mate"))
    # pairs inside one question's picks first (at most 11 x 11), then the relation as a filter
    inside = pool.select("qid", *key, "id").join(pool.select("qid", F.col("id").alias("mate")), "qid")
    mates = (inside.join(twins, [*key, "id", "mate"], "left_semi")
             .groupBy("qid", "id").agg(F.collect_set("mate").alias("mates")))
    rows = (pool.join(kinds, "id").join(mates, ["qid", "id"], "left").groupBy("qid").agg(F.array_sort(F.collect_list(
        F.struct(F.col("_o").alias("o"), "id", (F.col("kind") == "slide").alias("slide"),
                 F.coalesce("mates", F.array().cast(f"array<{dict(pool.dtypes)['id']}>")).alias("mates")))).alias("rows")))

    def step(kept: Column, row: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: F.array_contains(k["mates"], row["id"])), F.lit(True))
        twin = F.get(kept, (at - 1).cast("int"))
        swap = F.transform(kept, lambda k, i: F.when(i == at - 1, row).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(row))).when(row["slide"] & ~twin["slide"], swap).otherwise(kept)

    kept = F.aggregate("rows", F.slice("rows", 1, 0), step)
    return rows.select("qid", F.posexplode(F.transform(kept, lambda r: r["id"])).alias("_p", "id")).select(
        "qid", "id", (F.col("_p") + 1).alias("place"))


def enrich_pages(nodes: DataFrame, pages: DataFrame, notes: DataFrame, refined: DataFrame | None = None) -> DataFrame:
    """Page nodes with text preview, cleaned-up text and number of speaker notes."""
    preview = pages.select("deck_id", "page", F.substring("text", 1, PREVIEW_CHARS).alias("preview"))
    counts = notes.where(F.col("kind").isin("explain", "fact")).groupBy("deck_id", "page").agg(
        F.count("*").alias("n_notes"))
    out = nodes.join(preview, ["deck_id", "page"], "left").join(counts, ["deck_id", "page"], "left")
    if refined is not None:
        out = out.join(refined.select("deck_id", "page", F.col("text").alias("refined")), ["deck_id", "page"], "left")
    return out.withColumn("preview", F.coalesce("preview", F.lit(""))).fillna(0, ["n_notes"])


def enrich_chunks(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every chunk with its graph name and topic, or defaults from its own text."""
    meta = nodes.select("deck_id", "id", F.col("name").alias("_name"), F.col("topic").alias("_topic"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return (chunks.join(meta, ["deck_id", "id"], "left")
            .withColumn("name", F.coalesce(blank("_name"), F.substring("text", 1, NAME_CHARS)))
            .withColumn("topic", F.coalesce(blank("_topic"), F.lit(NO_TOPIC))).drop("_name", "_topic"))


def live_edges(edges: DataFrame, nodes: DataFrame, ident: str = "id", key: Sequence[str] = ()) -> DataFrame:
    """Edges whose two ends still exist."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(*key, F.col(ident).alias(end)).distinct(), [*key, end], "left_semi")
    return edges


def degrees(edges: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """``key..., node, degree``; a self loop counts once, like any other edge."""
    ends = edges.select(*key, F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return ends.groupBy(*key, "node").agg(F.count("*").alias("degree"))


def linked_split(nodes: DataFrame, edges: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Adds ``degree`` and ``linked``."""
    return nodes.join(degrees(edges, key), [*key, "node"], "left").fillna(0, ["degree"]).withColumn(
        "linked", F.col("degree") > 0)


def pages_in_need(nodes: DataFrame, edges: DataFrame, key: Sequence[str] = (), intro: str = "소개",
                  n: int = NEED_NOTES) -> DataFrame:
    """Per graph the best linked pages that nobody explained: ``nodes(key..., node, role, n_notes)``."""
    open_nodes = linked_split(nodes, edges, key).where(
        F.col("linked") & (F.col("n_notes") == 0) & (F.col("role") != intro))
    if key:
        return top_n(open_nodes, list(key), [F.col("degree").desc(), "node"], n, "place")
    return open_nodes.orderBy(F.col("degree").desc(), "node").limit(n)


def explanation_gaps(chunks: DataFrame) -> DataFrame:
    """Pages with a page chunk but no note chunk."""
    paged = chunks.where(F.coalesce("page", F.lit(0)) != 0)
    return paged.where(F.col("kind") == "slide").select("deck_id", "page").distinct().join(
        paged.where(F.col("kind") != "slide").select("deck_id", "page"), ["deck_id", "page"], "left_anti")


def topic_columns(chunks: DataFrame) -> DataFrame:
    """Adds ``place`` inside the topic: page chunks before notes, then by page (unknown last)."""
    order = F.struct((F.col("kind") != "slide").alias("note"), F.col("page").isNull().alias("unknown"), F.col("page").alias("page"))
    return number_ordered(chunks.withColumn("_order", order), ["deck_id", "topic"], ["_order", "ord"], "place").drop("_order")


def filter_chunks(chunks: DataFrame, text: str = "", kinds: Sequence[str] = ()) -> DataFrame:
    wanted = text.strip()
    if wanted:
        chunks = chunks.where(F.col("text").contains(wanted) | F.col("name").contains(wanted))
    return chunks.where(F.col("kind").isin(*kinds)) if kinds else chunks


def kind_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("deck_id", "kind").agg(F.count("*").alias("n"))
