"""Question-log analytics: ``at, session, question, q_chars, qtype, status, latency_ms, matched``.

``matched`` is null where nothing was expected, so it tells judged from unjudged questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import find_all, let
from ..plans.ranking import at_share, exact_index, median_high, number_ordered

# ---- fixed values -------------------------------------------------------------------
UNCLASSIFIED = "미분류"
DELETED_TITLE = "지워진 발표"
NO_EVIDENCE_ALARM, LONG_QUESTION, LONG_SHARE, SLOW_MS, SHOWN_MISSES = 0.3, 60, 0.2, 1000, 5
WORD = r"[가-힣]{2,}|[A-Za-z]{2,}|[0-9][0-9,.]*"
CLOSEST_CHARS = 60
STATUSES = ("ok", "no_evidence", "ignored")
# -------------------------------------------------------------------------------------


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _status(name: str) -> Column:
    return F.col("status") == name


def session_summary(log: DataFrame) -> DataFrame:
    """One row per session; rows without a session do not count."""
    return log.where(F.coalesce("session", F.lit("")) != "").groupBy("session").agg(
        F.count("*").alias("total"), _count(_status("ok")).alias("answered"),
        _count(_status("no_evidence")).alias("no_evidence"), _count(_status("ignored")).alias("ignored"),
        F.round(F.avg(F.when(_status("ok"), F.col("latency_ms"))), 1).alias("avg_latency_ms"),
        F.max("at").alias("last_at"))


def newest_first(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("last_at").desc())


def session_log(log: DataFrame, session: str) -> DataFrame:
    """One session's rows, newest first."""
    return log.where(F.col("session") == session).orderBy(F.col("at").desc())


def deck_summary(log: DataFrame) -> DataFrame:
    """Session summary plus judged questions and the hit rate over judged ones only."""
    judged = log.where(F.coalesce("session", F.lit("")) != "").groupBy("session").agg(
        F.count("matched").alias("expected_judged"), _count(F.col("matched")).alias("_hits"))
    rate = F.when(F.col("expected_judged") > 0, F.round(100 * F.col("_hits") / F.col("expected_judged"), 1))
    return session_summary(log).join(judged, "session").withColumn("expected_hit_rate", rate).drop("_hits")


def type_distribution(log: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce("qtype", F.lit("")) == "", UNCLASSIFIED).otherwise(F.col("qtype"))
    return log.where(F.coalesce("session", F.lit("")) != "").groupBy("session", kind.alias("qtype")).agg(
        F.count("*").alias("n"))


def global_stats(log: DataFrame) -> DataFrame:
    """Long table ``metric, label, n``: totals, counts by status and by type, judged and hit."""
    cells = log.groupBy("status", "qtype", "matched").agg(F.count("*").alias("n"))
    metrics = F.array(
        F.struct(F.lit("total").alias("metric"), F.lit("").alias("label")),
        F.struct(F.lit("status").alias("metric"), F.coalesce("status", F.lit("?")).alias("label")),
        F.struct(F.lit("qtype").alias("metric"), F.col("qtype").alias("label")),
        F.struct(F.lit("judged").alias("metric"), F.when(F.col("matched").isNotNull(), F.lit("")).alias("label")),
        F.struct(F.lit("hits").alias("metric"), F.when(F.col("matched"), F.lit("")).alias("label")))
    return (cells.select("n", F.explode(metrics).alias("m")).where(F.col("m.label").isNotNull())
            .where(~((F.col("m.metric") == "qtype") & (F.col("m.label") == "")))
            .groupBy("m.metric", "m.label").agg(F.sum("n").alias("n")))


def ordered_values(log: DataFrame) -> DataFrame:
    """``metric, place, value``: question lengths of all rows and latencies of answered rows, in order.

    A row per value instead of a list per log: places are numbered by ranges of values, so a log of any
    size spreads over tasks. Rows without the value are left out.
    """
    latency = F.when(F.col("status") == "ok", F.col("latency_ms"))
    values = F.array(F.struct(F.lit("q_chars").alias("metric"), F.col("q_chars").cast("double").alias("value")),
                     F.struct(F.lit("latency_ms").alias("metric"), latency.cast("double").alias("value")))
    rows = log.select(F.explode(values).alias("v")).select("v.*").where(F.col("value").isNotNull())
    counted = rows.groupBy("metric", "value").agg(F.count("*").alias("n"))
    return number_ordered(counted, ["metric"], ["value"], "_nth").transform(_places)


def _places(counted: DataFrame) -> DataFrame:
    """Every value as often as it occurs, with its place: ranges of distinct values carry the counts before them."""
    step = F.floor(F.col("_nth") / 65536)
    inside = Window.partitionBy("metric", "_step").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("metric").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_step", step)
    sums = placed.groupBy("metric", "_step").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (placed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["metric", "_step"])
            .select("metric", "value", F.explode(F.sequence(F.col("_before") + F.col("_inside") + 1, F.col("_before") + F.col("_inside") + F.col("n"))).alias("place"))
            .select("metric", "place", "value"))


def report(log: DataFrame) -> DataFrame:
    """The review as rows ``section, label, value, share, verdict``."""
    cells = log.groupBy("status", "qtype", "matched").agg(
        F.count("*").alias("n"), _count(F.col("q_chars") >= LONG_QUESTION).alias("n_long"))
    total = F.sum("n")
    by = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    facts = cells.agg(
        total.alias("total"), *[by(_status(s)).alias(s) for s in STATUSES], F.sum("n_long").alias("n_long"),
        by(F.col("matched").isNotNull()).alias("judged"), by(F.col("matched")).alias("hits"))

    def row(section: str, label: str, value: Column, share: Column, verdict: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(label).alias("label"), value.cast("double").alias("value"),
                        F.round(share.cast("double"), 6).alias("share"), verdict.cast("string").alias("verdict"))

    none = F.lit(None)
    n = F.col("total")
    alarm = F.when(F.col("no_evidence") / n > NO_EVIDENCE_ALARM, "too many").otherwise("fine")
    rows = [row("status", s, F.col(s), F.col(s) / n, alarm if s == "no_evidence" else none) for s in STATUSES]
    rows.append(row("length", "long questions", F.col("n_long"), F.col("n_long") / n,
                    F.when(F.col("n_long") / n < LONG_SHARE, "short enough").otherwise("summaries may help")))
    rows.append(row("expected", "hits", F.col("hits"), F.when(F.col("judged") > 0, F.col("hits") / F.col("judged")),
                    F.when(F.col("judged") == 0, "no record")))
    lengths = log.agg(F.percentile("q_chars", F.lit(0.5)).alias("median"), F.max("q_chars").alias("longest"))
    latency = exact_index(log.where(_status("ok")), [], "latency_ms", {"p50": median_high, "p95": at_share(0.95)})
    types = cells.where(F.coalesce("qtype", F.lit("")) != "").groupBy("qtype").agg(F.sum("n").alias("n"))
    all_typed = Window.partitionBy(F.lit(1))                                  # a handful of types
    type_rows = types.select(
        F.lit("type").alias("section"), F.col("qtype").alias("label"), F.col("n").cast("double").alias("value"),
        F.round(F.col("n") / F.sum("n").over(all_typed), 6).alias("share"), F.lit(None).cast("string").alias("verdict"))
    unfold = lambda df, items: df.select(F.explode(F.array(*items)).alias("r")).select("r.*")
    slow = F.when(F.col("p95") > SLOW_MS, "over budget").otherwise("within budget")
    return (unfold(facts, rows)
            .unionByName(unfold(lengths, [row("length", "median", F.col("median"), none, none),
                                          row("length", "longest", F.col("longest"), none, none)]))
            .unionByName(unfold(latency, [row("latency", "p50", F.col("p50"), none, none),
                                          row("latency", "p95", F.col("p95"), none, slow)]))
            .unionByName(type_rows))


def first_missed(log: DataFrame, n: int = SHOWN_MISSES) -> DataFrame:
    """The first questions that practice had not covered."""
    return log.where(~F.col("matched")).orderBy("at", "question").limit(n)


def portfolio(summary: DataFrame, titles: DataFrame) -> DataFrame:
    """Sessions with their deck titles, a fixed label where the deck is gone."""
    named = titles.select("session", F.col("title").alias("_title"))
    return summary.join(named, "session", "left").withColumn("title", F.coalesce("_title", F.lit(DELETED_TITLE))).drop("_title")


def portfolio_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("n_sessions"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
                       F.coalesce(F.sum("answered"), F.lit(0)).alias("answered"))


def mix(log: DataFrame) -> DataFrame:
    """``session, facet, label, n, percent, avg_latency_ms``: status and type mix of a session."""
    kind = F.when(F.coalesce("qtype", F.lit("")) == "", UNCLASSIFIED).otherwise(F.col("qtype"))
    cells = log.groupBy("session", "status", kind.alias("qtype")).agg(
        F.count("*").alias("n"), F.sum(F.when(_status("ok"), F.col("latency_ms"))).alias("ms"),
        F.count(F.when(_status("ok"), F.col("latency_ms"))).alias("n_ms"))
    facets = F.array(F.struct(F.lit("status").alias("facet"), F.col("status").alias("label")),
                     F.struct(F.lit("type").alias("facet"), F.col("qtype").alias("label")))
    rows = cells.select("session", "n", F.explode(facets).alias("f")).groupBy("session", "f.facet", "f.label").agg(
        F.sum("n").alias("n"))
    totals = cells.groupBy("session").agg(F.sum("n").alias("_all"), F.round(F.sum("ms") / F.sum("n_ms")).alias("avg_latency_ms"))
    return rows.join(totals, "session").withColumn("percent", F.round(100 * F.col("n") / F.col("_all")).cast("int")).drop("_all")


def expected_hits(asked: DataFrame, expected: DataFrame) -> DataFrame:
    """Was a live question practised? ``asked(qid, deck_id, question, slide)`` with the top source
    page or null; ``expected(deck_id, ord, question, page, gold_page)``.

    A deck's practice set holds a few questions per type, so it travels as one array per deck.
    The hit is the page; word overlap with the closest practised question is side information.
    Null without words in the question or without a source page.
    """
    words = lambda text: F.array_distinct(find_all(F.coalesce(text, F.lit("")), WORD))
    page = F.coalesce("gold_page", "page")
    sets = expected.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct(
        "ord", page.alias("page"), F.col("question").alias("question"), words(F.col("question")).alias("words")))).alias("_set"))
    joined = asked.join(sets, "deck_id", "left").withColumn("_words", words(F.col("question")))
    nothing = F.array().cast("array<struct<ord:bigint,page:int,question:string,words:array<string>>>")
    practised = F.coalesce("_set", nothing)

    def closest(own: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("question"))

        def step(acc: Column, e: Column) -> Column:
            shared = F.size(F.array_intersect(own, e["words"]))
            score = F.when((F.size(e["words"]) > 0) & (F.size(own) > 0),
                           shared / F.least(F.size(own), F.size(e["words"]))).otherwise(F.lit(0.0))
            return let(score, lambda s: F.when(s > acc["score"], F.struct(
                s.alias("score"), F.substring(e["question"], 1, CLOSEST_CHARS).alias("question"))).otherwise(acc))

        return F.aggregate(practised, start, step)

    judged = (F.size("_words") > 0) & F.col("slide").isNotNull()
    matched = F.exists(practised, lambda e: e["page"] == F.col("slide"))
    return (joined.withColumn("_best", closest(F.col("_words")))
            .withColumn("matched", F.when(judged, F.coalesce(matched, F.lit(False))))
            .withColumn("same_slide", F.col("matched"))
            .withColumn("text_overlap", F.when(judged, F.round("_best.score", 3)))
            .withColumn("closest_expected", F.when(judged, F.col("_best.question")))
            .drop("_set", "_words", "_best"))
