"""What may go to search at all: noise, unknown questions, generic questions, support checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profiles import LATIN, Profile
from ..functions.text import bigrams, content_only, content_words, fold, let, strip

# ---- fixed values -------------------------------------------------------------------
MIN_CHARS = 6
MIN_KNOWN_RATIO = 0.26
GROUNDED = 0.5
HIGHLIGHT_MAX = 3
NUMBER_AND_UNIT = r"^[0-9,.~%\s]+(?:[가-힣]{0,2}|[A-Za-z]{1,3})$"
# -------------------------------------------------------------------------------------

Words = Callable[[Column], Column]


def _in(word: Column, values) -> Column:
    return word.isin(*values) if values else F.lit(False)


def is_noise(text: Column, profile: Profile = LATIN, words: Words = content_words) -> Column:
    """Too short, or wordless without a question cue, or nothing but fillers."""
    said = strip(F.coalesce(text, F.lit("")))
    return (F.length(said) < MIN_CHARS) | let(words(said), lambda found: F.when(
        F.size(found) == 0, ~said.rlike(profile.question_cue)
    ).otherwise(F.forall(found, lambda w: _in(w, profile.fillers))))


def question_content(text: Column, profile: Profile = LATIN, words: Words = content_words) -> Column:
    """Content words of a question, repeats kept: no fillers, generic or question-talk words."""
    dull = sorted({*profile.fillers, *profile.meta_expand, *profile.talk_words})
    return F.filter(words(text), lambda w: (F.length(w) >= 2) & ~_in(w, dull))


def known_ratios(questions: DataFrame, vocab: DataFrame, profile: Profile = LATIN,
                 words: Words = content_words) -> DataFrame:
    """Adds ``n_content`` and ``ratio``: the share of content words the deck's vocabulary has
    (0 without content words)."""
    content = (questions.select("qid", "deck_id", F.explode_outer(
        question_content(F.col("question"), profile, words)).alias("_w")).where(F.col("_w").isNotNull())
        .groupBy("qid", "deck_id", F.lower("_w").alias("word")).agg(F.count("*").alias("_n")))
    known = vocab.select("deck_id", "word", F.lit(1).alias("_known"))
    ratios = (content.join(known, ["deck_id", "word"], "left").groupBy("qid").agg(
        F.sum("_n").alias("n_content"),
        (F.sum(F.when(F.col("_known") == 1, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("ratio")))
    return (questions.join(ratios, "qid", "left")
            .withColumn("n_content", F.coalesce("n_content", F.lit(0)))
            .withColumn("ratio", F.coalesce("ratio", F.lit(0.0))))


def meta_terms(text: Column, profile: Profile = LATIN, words: Words = content_words) -> Column:
    """Deck-side terms that a generic question may stand for."""
    pairs = [F.when(F.lit(True), F.array(*[F.lit(t) for t in terms]).cast("array<string>")) for terms in
             profile.meta_expand.values()]
    lookup = F.map_from_arrays(F.array(*[F.lit(w) for w in profile.meta_expand]), F.array(*pairs))
    none = F.array().cast("array<string>")
    by_word = F.flatten(F.transform(words(text), lambda w: F.coalesce(F.try_element_at(lookup, w), none)))
    by_cue = [F.when(text.rlike(p), F.array(*[F.lit(t) for t in terms])).otherwise(none)
              for p, terms in profile.meta_triggers]
    return F.array_distinct(F.concat(by_word, *by_cue))


def expand_meta(questions: DataFrame, vocab: DataFrame, profile: Profile = LATIN,
                words: Words = content_words) -> DataFrame:
    """Adds ``extra``: the meta terms that the deck's vocabulary really has, sorted."""
    terms = questions.select("qid", "deck_id", F.explode_outer(meta_terms(F.col("question"), profile, words)).alias("term"))
    present = (terms.where(F.col("term").isNotNull()).withColumn("word", F.lower("term"))
               .join(vocab.select("deck_id", "word"), ["deck_id", "word"], "left_semi")
               .groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("extra")))
    return questions.join(present, "qid", "left").withColumn(
        "extra", F.coalesce("extra", F.array().cast("array<string>")))


def guard_questions(questions: DataFrame, vocab: DataFrame, profile: Profile = LATIN,
                    words: Words = content_words, min_ratio: float = MIN_KNOWN_RATIO) -> DataFrame:
    """Adds ``status`` (ignored / no_evidence / null = go on), ``extra`` and ``query``.

    A question with content words needs enough of them in the deck. One made of generic words
    alone is rewritten to the deck's own terms; if the deck has none of them there is no
    evidence.
    """
    noisy = questions.withColumn("_noise", is_noise(F.col("question"), profile, words))
    rated = known_ratios(noisy, vocab, profile, words)
    expanded = expand_meta(rated, vocab, profile, words)
    has_content = F.col("n_content") > 0
    extra = F.when(has_content, F.array().cast("array<string>")).otherwise(F.col("extra"))
    unknown = F.when(has_content, F.col("ratio") < min_ratio).otherwise(F.size("extra") == 0)
    return (expanded.withColumn("status", F.when(F.col("_noise"), "ignored").when(unknown, "no_evidence"))
            .withColumn("extra", extra)
            .withColumn("query", F.when(F.size(extra) > 0, F.concat_ws(" ", F.col("question"), F.array_join(extra, " ")))
                        .otherwise(F.col("question")))
            .drop("_noise"))


def related(questions: DataFrame, vocab: DataFrame, profile: Profile = LATIN,
            words: Words = content_words) -> DataFrame:
    """Adds ``related``: answered already, or shares a word with the deck, or talks about the
    presentation. ``questions`` carries ``status``."""
    own = F.filter(F.transform(words(F.col("question")), lambda w: F.lower(w)),
                   lambda w: (F.length(w) >= 2) & ~_in(w, profile.fillers))
    touching = (questions.select("qid", "deck_id", F.explode_outer(F.array_distinct(own)).alias("word"))
                .where(F.col("word").isNotNull()).join(vocab.select("deck_id", "word"), ["deck_id", "word"], "left_semi")
                .select("qid").distinct().withColumn("_touch", F.lit(True)))
    generic = F.exists(F.transform(words(F.col("question")), lambda w: F.lower(w)),
                       lambda w: _in(w, list(profile.meta_expand)))
    return questions.join(touching, "qid", "left").withColumn(
        "related", (F.col("status") == "ok") | F.coalesce("_touch", F.lit(False)) | generic
        | F.col("question").rlike(profile.related_cue)).drop("_touch")


def leaks(text: Column, facts: Column) -> Column:
    """Does a follow-up give one of the facts away?"""
    return let(fold(text), lambda said: F.exists(facts, lambda f: said.contains(fold(f))))


def grounded_share(sentence: Column, source: Column) -> Column:
    """Share of the sentence's character pairs that the source has."""
    mine = bigrams(content_only(sentence))
    return let(mine, lambda x: F.when(
        F.size(x) > 0, F.size(F.array_intersect(x, bigrams(content_only(source)))) / F.size(x)).otherwise(F.lit(0.0)))


def highlight_words(keys: Column, text: Column, detail: Column) -> Column:
    """At most three distinct key phrases that stand literally in the text, no bare numbers."""
    good = lambda k: (F.length(k) >= 2) & ~k.rlike(NUMBER_AND_UNIT) & (F.contains(text, k) | F.contains(detail, k))
    # the text is searched until three are found, not for every word
    return F.aggregate(F.array_distinct(keys), F.array().cast("array<string>"), lambda acc, k: F.when(
        (F.size(acc) < HIGHLIGHT_MAX) & good(k), F.concat(acc, F.array(k))).otherwise(acc))
