"""Practice: did the answer name the facts, what is missed again and again, when to stop asking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profiles import LATIN, Profile
from ..functions.text import content_words, fold, is_number, let, useful_number
from ..plans.materialize import stored as written
from ..plans.ranking import top_n
from .evidence import SNIPPET, WORD_WEIGHTS, Words, best_lines, key_facts, page_context, question_context, question_pages

# ---- fixed values -------------------------------------------------------------------
BOOST = 2.0
WEAK_BELOW = 0.6
MOST_MISSED, WEAKEST = 10, 3
MAX_FOLLOWUP, ENOUGH = 2, 0.7
MIN_TARGET_CHARS = 80
ASK_NUMBER = "그 부분 구체적인 수치를 말씀해주실 수 있나요?"
ASK_OTHER = "방금 말씀하신 근거를 자료 어디에서 확인할 수 있는지 짚어주시겠어요?"
# -------------------------------------------------------------------------------------


def _has(answer: Column, facts: Column, inside: bool) -> Column:
    return let(fold(answer), lambda said: F.filter(
        facts, lambda f: said.contains(fold(f)) if inside else ~said.contains(fold(f))))


def with_facts(questions: DataFrame, chunks: DataFrame, vocab: DataFrame, profile: Profile = LATIN,
               qtype: str | None = None, words: Words = content_words) -> DataFrame:
    """Adds ``snippet``, ``facts`` and ``page_text`` from the question's gold page
    (``qid, deck_id, page, question``). A question without its page has no facts.

    The line is chosen as for a question of the default type, or of ``qtype``.
    """
    # the pages that questions name are written once
    target = written(chunks.select("deck_id", "page", "id", "text").join(
        questions.select("deck_id", "page").distinct(), ["deck_id", "page"], "left_semi"), "named-pages")
    gold = questions.select("qid", "deck_id", "page").join(target, ["deck_id", "page"])
    pages = page_context(target, vocab, words=words).drop("page")
    asked = question_context(questions.select("qid", "deck_id", "question"), vocab, profile, words).withColumn(
        "qtype", F.lit(qtype or profile.qtype_default))
    texts = gold.select("qid", F.substring("text", 1, SNIPPET).alias("_head"), F.col("text").alias("page_text"))
    pairs = question_pages(gold.select("qid", "id"), asked, pages.drop("deck_id"))
    best = best_lines(pairs, profile).join(texts, "qid")
    line = F.coalesce(F.col("best.line"), "_head")
    line_words = F.coalesce(F.col("best.words"), words(line))
    found = best.select("qid", "page_text", line.alias("snippet"),
                        key_facts(line, line_words, F.coalesce("best.keys", F.array().cast(WORD_WEIGHTS)), profile).alias("facts"))
    return questions.join(found, "qid", "left").withColumn(
        "facts", F.coalesce("facts", F.array().cast("array<string>"))).fillna("", ["snippet", "page_text"])


def judge(answered: DataFrame, words: Words = content_words) -> DataFrame:
    """Adds ``covered``, ``missed``, ``ratio``, ``measurable``, ``elsewhere``, ``off_line``.

    ``elsewhere`` are useful numbers of the answer that stand on the page, but not in the line
    the facts came from. They only count when something is missing.
    """
    missed = _has(F.col("answer"), F.col("facts"), False)
    said = F.filter(words(F.col("answer")), lambda w: is_number(w) & useful_number(w))
    elsewhere = let(fold(F.col("page_text")), lambda page: let(fold(F.col("snippet")), lambda line: F.filter(
        said, lambda w: page.contains(fold(w)) & ~line.contains(fold(w)))))
    n = F.size("facts")
    ratio = F.when(n > 0, F.size("covered") / n).otherwise(F.lit(0.0))
    none = F.array().cast("array<string>")
    return (answered.withColumn("covered", _has(F.col("answer"), F.col("facts"), True)).withColumn("missed", missed)
            .withColumn("ratio", F.round(ratio, 9)).withColumn("measurable", n > 0)
            .withColumn("elsewhere", F.when(F.size("missed") > 0, elsewhere).otherwise(none))
            .withColumn("off_line", (F.size("elsewhere") > 0) & (F.col("ratio") < 0.5)))


def weak_facts(judged: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``deck_id, page, fact, asked, missed``; a stored table of earlier practice is added up."""
    new = judged.select("deck_id", "page", F.explode("facts").alias("fact"), F.col("missed").alias("_missed")).select(
        "deck_id", "page", "fact", F.lit(1).cast("bigint").alias("asked"),
        F.when(F.array_contains("_missed", F.col("fact")), 1).otherwise(0).cast("bigint").alias("missed"))
    rows = new if stored is None else new.unionByName(stored.select(*new.columns))
    return rows.groupBy("deck_id", "page", "fact").agg(F.sum("asked").alias("asked"), F.sum("missed").alias("missed"))


def weak_types(judged: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``qtype, asked, covered``: sum of coverage ratios, 1.0 for a question without facts."""
    share = F.when(F.size("facts") > 0, F.size("covered") / F.size("facts")).otherwise(F.lit(1.0))
    new = judged.select("qtype", F.lit(1).cast("bigint").alias("asked"), share.alias("covered"))
    rows = new if stored is None else new.unionByName(stored.select(*new.columns))
    return rows.groupBy("qtype").agg(F.sum("asked").alias("asked"), F.sum("covered").alias("covered"))


def miss_rates(facts: DataFrame) -> DataFrame:
    rate = F.when(F.col("asked") > 0, F.col("missed") / F.col("asked")).otherwise(F.lit(0.0))
    return facts.withColumn("miss_rate", rate).withColumn("boost", BOOST * rate)


def flag_weak_types(types: DataFrame, below: float = WEAK_BELOW) -> DataFrame:
    return types.withColumn("weak", (F.col("asked") > 0) & (F.col("covered") / F.col("asked") < below))


def most_missed(facts: DataFrame, n: int = MOST_MISSED) -> DataFrame:
    rates = miss_rates(facts.where((F.col("asked") > 0) & (F.col("missed") > 0)))
    return rates.withColumn("miss_rate", F.round("miss_rate", 9)).orderBy(
        F.col("miss_rate").desc(), F.col("missed").desc(), "deck_id", "page", "fact").limit(n).select(
        "deck_id", "page", "fact", "asked", "missed", "miss_rate")


def drill_summary(judged: DataFrame) -> DataFrame:
    """One row: answers, mean ratio over measurable ones (null if none), unmeasurable ones."""
    return judged.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("measurable"), F.col("ratio"))), 6).alias("mean_ratio"),
                      F.count(F.when(~F.col("measurable"), 1)).alias("n_unmeasurable"))


def weakest_answers(judged: DataFrame, n: int = WEAKEST) -> DataFrame:
    return judged.orderBy("ratio", "qid").limit(n).where(F.col("ratio") < 1.0)


def practice_set(candidates: DataFrame, per_type: int) -> DataFrame:
    """The first questions of every type per deck (``ord``): ``deck_id, qtype, ord, place, ...``."""
    return top_n(candidates, ["deck_id", "qtype"], ["ord"], per_type, "place")


def attach_gold(made: DataFrame, chunks: DataFrame) -> DataFrame:
    return made.join(chunks.select("deck_id", "page", F.col("id").alias("gold_id")), ["deck_id", "page"], "left")


def drill_turns(turns: DataFrame) -> DataFrame:
    """Follow a question through its answers: ``qid, depth, ask, ratio, n_missing, done``.

    ``turns(qid, question, facts, followup, depth, answer)``, depth 0 being the first answer.
    Facts named in an earlier answer stay covered. Asking ends at depth two, or when no number
    is missing and at least 70 % is covered. Depth ends the drill, so a question gathers three
    answers at most.
    """
    used = turns.where(F.col("depth") <= MAX_FOLLOWUP)
    rows = used.groupBy("qid", "question", "facts", "followup").agg(
        F.array_sort(F.collect_list(F.struct("depth", "answer"))).alias("said"))

    def step(acc: Column, turn: Column) -> Column:
        left = _has(F.coalesce(turn["answer"], F.lit("")), acc["left"], False)
        n = F.size("facts")

        def close(missing: Column) -> Column:
            ratio = F.when(n > 0, (n - F.size(missing)) / n).otherwise(F.lit(1.0))
            number = F.exists(missing, is_number)
            done = (turn["depth"] >= MAX_FOLLOWUP) | (~number & (ratio >= ENOUGH))
            prepared = let(fold(F.col("followup")), lambda q: F.when(
                (F.col("followup") != "") & (turn["depth"] == 0) & ~F.exists(missing, lambda f: q.contains(fold(f))),
                F.col("followup")))
            ask = F.coalesce(prepared, F.when(number, ASK_NUMBER).otherwise(ASK_OTHER))
            return F.struct(missing.alias("left"), ask.alias("ask"), done.alias("over"), F.concat(acc["out"], F.array(
                F.struct(turn["depth"].alias("depth"), acc["ask"].alias("ask"), F.round(ratio, 9).alias("ratio"),
                         F.size(missing).alias("n_missing"), done.alias("done")))).alias("out"))

        return F.when(acc["over"], acc).otherwise(let(left, close))

    start = F.struct(
        F.col("facts").alias("left"), F.col("question").alias("ask"), F.lit(False).alias("over"),
        F.array().cast("array<struct<depth:int,ask:string,ratio:double,n_missing:int,done:boolean>>").alias("out"))
    return rows.select("qid", F.explode(F.aggregate("said", start, step)["out"]).alias("t")).select("qid", "t.*")
