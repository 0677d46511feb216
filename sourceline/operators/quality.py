"""Quality gate: which pages text search cannot see, and what to read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profiles import KOREAN, Profile
from ..functions.text import body_part, find_all, let, letter_count, notes_part, top_char_count, with_notes
from ..plans.ranking import exact_index, median_high, number_rows

# ---- fixed values -------------------------------------------------------------------
MIN_LETTERS = 20
MIN_SYLLABLES, MAX_TOP_SHARE = 15, 0.25
FAIL_RATIO, WARN_RATIO = 0.15, 0.05
THIN_PAGE, BULLET_BODY = 30, 60
GLYPH_ONLY = (r"^[\s\x{2022}\x{25aa}\x{25cf}\x{2756}\x{2713}\x{2219}\x{00b7}\x{2010}-\x{2015}\-\*"
              r"\x{25a0}\x{25b6}\x{2192}\x{27a2}\x{25ab}\x{2043}\x{25e6}]+$")
BULLET_GLYPH = r"[\x{2022}\x{2756}\x{27a2}\x{2713}]"
REASONS = ("daily_quota", "call_limit", "render_failed", "caption_error")
# -------------------------------------------------------------------------------------


def garbled(text: Column, profile: Profile = KOREAN) -> Column:
    """Fifteen characters or more, over a quarter of them the same one."""
    return let(find_all(text, profile.alphabet), lambda chars: (F.size(chars) >= MIN_SYLLABLES) & (
        top_char_count(chars) / F.size(chars) > MAX_TOP_SHARE))


def grade_pages(pages: DataFrame, profile: Profile = KOREAN) -> DataFrame:
    """Adds ``letters``, ``garbled``, ``dead``, ``glyph_only``, ``bullet_no_body``."""
    return (pages.withColumn("letters", letter_count(F.col("text"), profile.letter))
            .withColumn("garbled", garbled(F.col("text"), profile))
            .withColumn("dead", (F.col("letters") < MIN_LETTERS) | F.col("garbled"))
            .withColumn("glyph_only", F.col("text").rlike(GLYPH_ONLY))
            .withColumn("bullet_no_body", F.col("text").rlike(BULLET_GLYPH) & (F.col("letters") < BULLET_BODY)))


def deck_verdicts(graded: DataFrame) -> DataFrame:
    """One row per deck: total, dead, ratio, interpolated median of letters, verdict."""
    ratio = F.col("n_dead") / F.col("total")
    return (graded.groupBy("deck_id").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("dead"), 1)).alias("n_dead"),
        F.percentile("letters", F.lit(0.5)).alias("median_letters"))
        .withColumn("dead_ratio", F.round(ratio, 3))
        .withColumn("verdict", F.when(ratio > FAIL_RATIO, "fail").when(ratio > WARN_RATIO, "warn").otherwise("good")))


def dead_pages(graded: DataFrame) -> DataFrame:
    return graded.where("dead").select("deck_id", "page")


def length_profile(pages: DataFrame) -> DataFrame:
    """``deck_id, shortest, middle, longest, n_thin``; the middle is the upper median."""
    spread = exact_index(pages, ["deck_id"], "n_chars", {"middle": median_high}, width=100.0)
    return pages.groupBy("deck_id").agg(
        F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"),
        F.count(F.when(F.col("n_chars") < THIN_PAGE, 1)).alias("n_thin")).join(spread, "deck_id")


def unusable_pages(pages: DataFrame, profile: Profile = KOREAN) -> DataFrame:
    """Pages whose body (notes aside) cannot be used as text."""
    body = body_part(F.coalesce(F.col("text"), F.lit("")))
    return pages.where((letter_count(body, profile.letter) < MIN_LETTERS) | garbled(body, profile))


def read_key(content: Column, provider: str, model: str, prompt: str) -> Column:
    """Cache key of a page image: content, model and prompt."""
    tail = F.lit(f"{provider}|{model}|{prompt}".encode("utf-8"))
    return F.sha2(F.concat(content.cast("binary"), tail), 256)


def reread_plan(needed: DataFrame, cached: DataFrame, max_calls: int | None = None) -> DataFrame:
    """Adds ``action``: ``cached`` pages cost nothing, the first ``max_calls`` others of a deck
    are ``read``, the rest are ``over_limit``. ``needed(deck_id, page, key)``, ``cached(key)``."""
    known = cached.select("key").distinct()
    free = needed.join(known, "key", "left_semi").withColumn("action", F.lit("cached"))
    todo = needed.join(known, "key", "left_anti")
    if max_calls is None:
        return free.unionByName(todo.withColumn("action", F.lit("read")))
    placed = number_rows(todo, ["deck_id"], "page", "_n")
    read = placed.withColumn("action", F.when(F.col("_n") <= max_calls, "read").otherwise("over_limit")).drop("_n")
    return free.unionByName(read)


def merge_recovered(text_pages: DataFrame, recovered: DataFrame) -> DataFrame:
    """Text pages with unusable bodies replaced by recovered text, speaker notes kept.

    ``text_pages(deck_id, page, text)``, ``recovered(deck_id, page, text)`` (text null: the page
    could not be read). A page that failed keeps whatever text it had.
    """
    new = recovered.select("deck_id", "page", F.col("text").alias("_new"), F.lit(True).alias("_tried"))
    both = text_pages.join(new, ["deck_id", "page"], "full_outer")
    body = with_notes(F.col("_new"), notes_part(F.coalesce("text", F.lit(""))))
    done = both.withColumn("origin", F.when(F.col("_new").isNotNull(), "caption")).withColumn(
        "text", F.when(F.col("_new").isNotNull(), body).otherwise(F.col("text")))
    return (done.withColumn("failed", F.coalesce("_tried", F.lit(False)) & F.col("_new").isNull())
            .drop("_new", "_tried").withColumn("n_chars", F.length("text")))


def merge_summary(merged: DataFrame, failures: DataFrame) -> DataFrame:
    """Per deck: method (text, image, mixed), recovered and failed pages, and the most useful
    failure reason. ``failures(deck_id, page, reason)``."""
    priority = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason")), F.lit(99))
    reason = failures.groupBy("deck_id").agg(F.min_by("reason", priority).alias("_reason"))
    counts = merged.groupBy("deck_id").agg(
        F.count("*").alias("total"), F.count("origin").alias("n_recovered"),
        F.count(F.when(F.col("failed"), 1)).alias("n_failed"))
    method = (F.when(F.col("n_recovered") == 0, "text").when(F.col("n_recovered") == F.col("total"), "image")
              .otherwise("mixed"))
    return counts.join(reason, "deck_id", "left").withColumn("method", method).withColumn(
        "reason", F.when(F.col("n_failed") > 0, F.col("_reason"))).drop("_reason")
