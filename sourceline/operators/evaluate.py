"""Evaluation of retrievers, classifiers and guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..plans.ranking import at_share, exact_index, first_per_group, median_high, top_n

# ---- fixed values -------------------------------------------------------------------
RECALL_AT = (1, 3, 5)
MISS_BELOW = 3
DIAGNOSE_DEPTH = 20
SHARED_TERMS = 12
PREVIEW_CHARS = 90
THRESHOLDS = 51            # 0.00 .. 1.00 in steps of 0.02
KEEP_WEIGHT = 2
# -------------------------------------------------------------------------------------


def resolve_gold(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold chunk ids per question: ``qid, id``.

    ``questions(qid, gold_ids, gold_id, gold_pages, gold_page)``: the first of the four that
    is present counts. Pages are looked up per page, ids per id; what does not resolve
    disappears, and with it a question without any gold.
    """
    has = lambda name: F.size(F.coalesce(F.col(name), F.array())) > 0
    by_id = F.when(has("gold_ids"), F.col("gold_ids")).when(
        F.coalesce(F.col("gold_id"), F.lit("")) != "", F.array("gold_id"))
    by_page = F.when(has("gold_pages"), F.col("gold_pages")).when(
        F.col("gold_page").isNotNull(), F.array("gold_page"))
    wanted = questions.select("qid", "deck_id", by_id.alias("ids"),
                              F.when(by_id.isNull(), by_page).alias("pages"))
    ids = wanted.select("qid", F.explode("ids").alias("id")).join(chunks.select("id"), "id", "left_semi")
    pages = wanted.select("qid", "deck_id", F.explode("pages").alias("page")).join(
        chunks.select("deck_id", "page", "id"), ["deck_id", "page"])
    return ids.select("qid", "id").unionByName(pages.select("qid", "id")).distinct()


def gold_ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Every question with gold, and the rank of its first gold hit or null."""
    found = hits.join(gold.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(
        F.min("rank").alias("rank"))
    return gold.select("qid").distinct().join(found, "qid", "left")


def recall_report(hits: DataFrame, gold: DataFrame, at: Sequence[int] = RECALL_AT) -> DataFrame:
    """One row: questions, recall at each depth, mean reciprocal rank over all questions."""
    rank = F.col("rank")
    shares = [F.round(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in at]
    return gold_ranks(hits.where(F.col("rank") <= max(at)), gold).agg(
        F.count("*").alias("n"), *shares, F.round(F.avg(F.coalesce(1 / rank, F.lit(0.0))), 6).alias("mrr"))


def misses(hits: DataFrame, gold: DataFrame, below: int = MISS_BELOW, depth: int = max(RECALL_AT)) -> DataFrame:
    """Questions whose gold is not in the top ``below``: ``qid, rank`` (null beyond ``depth``)."""
    ranks = gold_ranks(hits.where(F.col("rank") <= depth), gold)
    return ranks.where(F.col("rank").isNull() | (F.col("rank") > below))


def diagnose(hits: DataFrame, gold: DataFrame, questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Why a question missed: gold id and rank, shared terms, and what came instead."""
    missed = misses(hits, gold, depth=DIAGNOSE_DEPTH)
    target = gold.groupBy("qid").agg(F.min("id").alias("gold_id"))
    came = (top_n(hits, ["qid"], ["rank"], 3, "_n").join(missed.select("qid"), "qid", "left_semi")
            .join(docs.select("id", F.regexp_replace(F.substring("text", 1, PREVIEW_CHARS), "\n", " ").alias("preview")), "id")
            .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "preview"))).alias("came")))
    shared = F.slice(F.array_sort(F.array_intersect(
        F.array_distinct(lexical_tokens(F.col("question"))), F.array_distinct(lexical_tokens(F.col("text"))))), 1, SHARED_TERMS)
    return (missed.join(target, "qid").join(questions.select("qid", "question"), "qid")
            .join(docs.select(F.col("id").alias("gold_id"), "text"), "gold_id")
            .join(came, "qid", "left")
            .select("qid", "gold_id", F.col("rank").alias("gold_rank"), shared.alias("shared_terms"), "came"))


def leaderboard(runs: Mapping[str, DataFrame], gold: DataFrame) -> DataFrame:
    """One row per retriever with its place by recall at 3 (listing order breaks ties)."""
    reports = None
    for order, (name, hits) in enumerate(runs.items()):
        row = recall_report(hits, gold).withColumn("retriever", F.lit(name)).withColumn("_ord", F.lit(order))
        reports = row if reports is None else reports.unionByName(row)
    best_first = Window.orderBy(F.col("recall_3").desc(), "_ord")      # a handful of rows
    return reports.withColumn("place", F.row_number().over(best_first)).drop("_ord")


def latency_profile(log: DataFrame, group: Sequence[str] = (), value: str = "latency_ms") -> DataFrame:
    """p50 at index n//2 and p95 at min(n-1, int(.95n)) of the sorted values: exact values, not
    interpolated ones."""
    return exact_index(log, group, value, {"p50": median_high, "p95": at_share(0.95)})


def class_report(pairs: DataFrame) -> DataFrame:
    """``actual, predicted`` → per class: n, hits, predicted, recall, precision, and accuracy."""
    cells = pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    by_actual = cells.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("n"), hit.alias("hits"))
    by_pred = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    total = cells.agg((hit / F.sum("n")).alias("accuracy"))
    share = lambda top, below: F.round(F.when(below > 0, top / below).otherwise(0.0), 6)
    return (by_actual.join(by_pred, "label", "left").fillna(0, ["n_predicted"])
            .select("label", "n", "hits", "n_predicted",
                    share(F.col("hits"), F.col("n")).alias("recall"),
                    share(F.col("hits"), F.col("n_predicted")).alias("precision"),
                    F.round(total.scalar(), 6).alias("accuracy")))


def confusion(pairs: DataFrame, labels: Sequence) -> DataFrame:
    return pairs.groupBy("actual").pivot("predicted", list(labels)).count().fillna(0)


def majority_label(labelled: DataFrame, label: str = "label") -> DataFrame:
    """One row: the most frequent label and its count (smallest label on a tie)."""
    return labelled.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), label).limit(1)


def knn_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Similarity-weighted vote. ``neighbours(qid, id, score)``, ``labels(id, label)`` →
    ``qid, label, weight``."""
    votes = neighbours.join(labels, "id").groupBy("qid", "label").agg(F.round(F.sum("score"), 6).alias("weight"))
    return first_per_group(votes, ["qid"], [F.col("weight").desc(), "label"])


def best_of(scores: DataFrame) -> DataFrame:
    """``name, accuracy, ord`` → winner and the verdict on the last candidate against the
    baselines before it (``kind`` majority, rules, knn)."""
    best = scores.orderBy(F.col("accuracy").desc(), "ord").limit(1)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("accuracy")))
    verdict = scores.agg(of("majority").alias("m"), of("rules").alias("r"), of("knn").alias("k")).select(
        F.when(F.col("k") <= F.col("m"), "below baseline")
         .when(F.col("k") <= F.col("r"), "rules as good").otherwise("worth its cost").alias("verdict"))
    return best.select(F.col("name").alias("winner"), "accuracy", verdict.scalar().alias("verdict"))


def ratio_profile(ratios: DataFrame, group: Sequence[str]) -> DataFrame:
    """Smallest, upper median and largest ratio per group."""
    return exact_index(ratios, group, "ratio", {
        "lowest": lambda n: F.lit(0), "middle": median_high, "highest": lambda n: n - 1}, width=0.05)


def guard_calibration(ratios: DataFrame) -> DataFrame:
    """``ratio, related`` → every threshold with pass rate, block rate and score, and the
    recommended one: the middle of the thresholds tied for the best score.

    Ratios are counted per distinct value first, so the thresholds meet a short table
    however many questions were asked.
    """
    counts = ratios.groupBy("related", F.round("ratio", 9).alias("ratio")).agg(F.count("*").alias("n"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1)), lambda i: i * 2 / F.lit(100.0))
    spread = counts.withColumn("threshold", F.explode(steps))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    related = F.col("related")
    table = spread.groupBy("threshold").agg(
        F.round(total(related & (F.col("ratio") >= F.col("threshold"))) / total(related), 6).alias("pass_rate"),
        F.round(total(~related & (F.col("ratio") < F.col("threshold"))) / total(~related), 6).alias("block_rate"))
    table = table.withColumn("score", F.round(KEEP_WEIGHT * F.col("pass_rate") + F.col("block_rate"), 6))
    everything = Window.partitionBy(F.lit(1))                                  # 51 rows
    tied = Window.partitionBy("score").orderBy("threshold")
    n_tied = F.count("*").over(Window.partitionBy("score"))
    return table.select(
        F.round("threshold", 2).alias("threshold"), "pass_rate", "block_rate", "score",
        ((F.col("score") == F.max("score").over(everything))
         & (F.row_number().over(tied) == F.floor(n_tied / 2) + 1)).alias("recommended"))


def status_report(log: DataFrame, values: Sequence[str] = ("latency_ms",)) -> DataFrame:
    """Counts by status, with p50/p95 (min(n-1, int(n*p))) of each value over the ok rows."""
    counts = log.groupBy("status").agg(F.count("*").alias("n"))
    ok = log.where(F.col("status") == "ok")
    for value in values:
        profile = exact_index(ok, ["status"], value, {
            f"{value}_p50": at_share(0.5), f"{value}_p95": at_share(0.95)})
        counts = counts.join(profile, "status", "left")
    return counts


def compare_predicates(df: DataFrame, old: Column, new: Column, expected: Column) -> DataFrame:
    """Old against new verdict: one row per combination with its count and the new one's errors."""
    return (df.select(old.alias("old"), new.alias("new"), expected.alias("expected"))
            .groupBy("old", "new", "expected").agg(F.count("*").alias("n"))
            .withColumn("wrong", F.when(F.col("new") != F.col("expected"), F.col("n")).otherwise(0)))


def question_coverage(generated: DataFrame, targets: DataFrame) -> DataFrame:
    """Questions per target page, zero where none was generated."""
    counts = generated.groupBy("deck_id", "page").agg(F.count("*").alias("n_questions"))
    return targets.select("deck_id", "page").join(counts, ["deck_id", "page"], "left").fillna(0, ["n_questions"])
