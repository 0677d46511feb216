"""Evidence lines and keywords.

A question meets only the pages it hit, so the unit of work is one row of a page with its prepared
lines and the weighted words of the questions that hit it. A page's words are looked up by its
questions, so neither its lines nor their words are rows, and a page does not travel with every question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.profiles import LATIN, Profile
from ..functions.text import (SHOWN_BULLET, candidate_lines, content_words, is_number, let, refined_lines,
                              useful_number)
from ..plans.materialize import stored
from ..plans.ranking import top_n
from .classify import question_type

Words = Callable[[Column], Column]

# ---- fixed values -------------------------------------------------------------------
PARTIAL = 0.7
PER_MATCH = 0.4
RAW_WEIGHT = 1.2
TYPE_BONUS, HEADING_LOSS, SHORT_FIRST_LOSS, SHORT_LOSS, COUNTED_BONUS = 2.0, 2.5, 3.0, 1.5, 1.2
SHORT_FIRST, SHORT, LONG, LONG_LOSS = 30, 14, 90, 0.004
RANK_BONUS = (3.0, 1.5, 0.0, 0.0, 0.0)
SNIPPET = 120
NUMBER_BONUS = 2.5
KEYWORDS_PER_LINE, KEYWORDS = 5, 6
MIN_FACT_IDF, MAX_FACTS = 1.6, 6
GENERAL_NOTES, FALLBACK_NOTES = 3, 10
# -------------------------------------------------------------------------------------

ASKED_PER_ROW = 256     # questions that a row of a page carries, about
STRETCHED = 40          # characters of a word up to which all its stretches are listed

WORD_WEIGHTS = "array<struct<word:string,idf:double>>"


def _get(array: Column, i: int = 0) -> Column:
    return F.get(array, F.lit(i))


def page_lines(chunks: DataFrame, refined: DataFrame | None = None, words: Words = content_words) -> DataFrame:
    """Adds ``lines`` (``array<struct<idx, line, words, keys>>``) and ``from_refined``.

    Cleaned-up text of the page supplies the lines where it yields any; otherwise the raw text.
    """
    raw = candidate_lines(F.col("text"))
    if refined is None:
        picked = chunks.withColumn("_lines", raw).withColumn("from_refined", F.lit(False))
    else:
        tidy = refined.select("deck_id", "page", F.col("text").alias("_tidy"))
        picked = (chunks.join(tidy, ["deck_id", "page"], "left")
                  .withColumn("_good", refined_lines(F.coalesce("_tidy", F.lit(""))))
                  .withColumn("from_refined", F.size("_good") > 0)
                  .withColumn("_lines", F.when(F.col("from_refined"), F.col("_good")).otherwise(raw))
                  .drop("_tidy", "_good"))
    shaped = F.transform(F.col("_lines"), lambda c, i: let(words(c["line"]), lambda ws: F.struct(
        i.alias("idx"), c["line"].alias("line"), ws.alias("words"),
        F.array_distinct(F.transform(ws, lambda w: F.lower(w))).alias("keys"))))
    return picked.withColumn("lines", shaped).drop("_lines")


def page_context(chunks: DataFrame, vocab: DataFrame, refined: DataFrame | None = None,
                 only: DataFrame | None = None, words: Words = content_words) -> DataFrame:
    """``deck_id, id, page, lines, from_refined, weights``; ``weights`` are the page's own words
    with their idf. ``only(id)`` restricts the work to pages that were hit."""
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if only is not None:
        chunks = chunks.join(only.select("id").distinct(), "id", "left_semi")
    # texts travel, not the lines made of them; pages are work, not bytes, so their tasks are never merged
    placed = chunks.select("deck_id", "id", "page", "text").repartition(tasks, "id")
    pages = page_lines(placed, refined, words).select("deck_id", "id", "page", "lines", "from_refined")
    used = page_lines(chunks, refined, words).select("deck_id", "id", F.explode_outer(F.array_distinct(F.flatten(F.col("lines.keys")))).alias("word"))
    weights = (used.where(F.col("word").isNotNull())
               .join(vocab.select("deck_id", "word", "idf"), ["deck_id", "word"])
               .groupBy("id").agg(F.collect_list(F.struct("word", "idf")).alias("weights")))
    return pages.join(weights, "id", "left").withColumn("weights", F.coalesce("weights", F.array().cast(WORD_WEIGHTS)))


def question_context(questions: DataFrame, vocab: DataFrame, profile: Profile = LATIN,
                     words: Words = content_words) -> DataFrame:
    """``qid, deck_id, question, qtype, asked, raw, top_idf``.

    ``asked`` are the distinct lower-cased words with their idf (null: unknown to the deck),
    ``raw`` stretches of the question that stand for unknown words the extractor cut short.
    """
    extra = F.col("extra") if "extra" in questions.columns else F.array().cast("array<string>")
    own = F.array_distinct(F.transform(F.concat(words(F.col("question")), extra), lambda w: F.lower(w)))
    base = questions.select("qid", "deck_id", "question", own.alias("_own"))
    known = (base.select("qid", "deck_id", F.explode_outer("_own").alias("word")).where(F.col("word").isNotNull())
             .join(vocab.select("deck_id", "word", "idf"), ["deck_id", "word"], "left")
             .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("word", "idf"))).alias("asked")))
    peak = vocab.groupBy("deck_id").agg(F.max("idf").alias("top_idf"))
    empty = F.array().cast(WORD_WEIGHTS)
    return (base.join(known, "qid", "left").join(peak, "deck_id", "left")
            .withColumn("asked", F.coalesce("asked", empty))
            .withColumn("top_idf", F.coalesce("top_idf", F.lit(1.0)))
            .withColumn("raw", raw_keys(F.col("question"), F.col("asked"), profile))
            .withColumn("qtype", question_type(F.col("question"), profile))
            .drop("_own"))


def raw_keys(question: Column, asked: Column, profile: Profile = LATIN) -> Column:
    """For every unknown word: question tokens that start like it and run on for at least three
    letters, cut to the word's length."""
    letters = profile.alphabet
    unknown = F.filter(asked, lambda a: a["idf"].isNull() & (F.length(a["word"]) >= 2)
                       & a["word"].rlike(f"^{letters}"))
    spaced = F.split(question, r"[\s\p{Z}]+")
    return let(spaced, lambda toks: F.array_distinct(F.flatten(F.transform(unknown, lambda a: F.transform(
        F.filter(toks, lambda t: F.startswith(t, F.substring(a["word"], 1, 2)) & t.rlike(f"^{letters}{{3,}}")),
        lambda t: F.substring(F.regexp_extract(t, f"^({letters}{{3,}})", 1), F.lit(1), F.length(a["word"])))))))


@lru_cache(1 << 14)
def _stretches(word: str) -> frozenset[str]:
    """All stretches of two characters or more."""
    return frozenset(word[i:j] for i in range(len(word) - 1) for j in range(i + 2, len(word) + 1))


class _Page:
    """The weighted words of a page's lines: which lines a question's words reach, and for how much."""

    def __init__(self, keys: list[list[str]], weights: list[tuple[str, float]]) -> None:
        self.idf: dict[str, float] = {}
        for word, idf in weights:
            known = self.idf.get(word)
            self.idf[word] = idf if known is None or (idf is not None and idf > known) else known
        self._lines: dict[str, list[int]] = {}
        for i, line in enumerate(keys):
            for word in line:
                if word in self.idf:
                    self._lines.setdefault(word, []).append(i)
        self._long = {w for w in self._lines if len(w) >= 2 and w[0] not in "0123456789"}
        self._joined = "\0".join(["", *self._long, ""])
        self._found: dict[str, dict[int, float]] = {}

    def _holding(self, word: str) -> Iterator[str]:
        """Words that contain ``word``."""
        at = self._joined.find(word)
        while at >= 0:
            end = self._joined.index("\0", at)
            yield self._joined[self._joined.rindex("\0", 0, at) + 1:end]
            at = self._joined.find(word, end)

    def _near(self, word: str) -> dict[int, float]:
        """Lines with a word that contains ``word`` or is contained in it, and the rarest one's idf."""
        found = self._found.get(word)
        if found is None:
            found = self._found[word] = {}
            partners = _stretches(word) & self._long if len(word) <= STRETCHED else {w for w in self._long if w in word}
            for partner in {*partners, *self._holding(word)}:
                idf = self.idf[partner]
                for i in self._lines[partner] if idf is not None else ():
                    if i not in found or idf > found[i]:
                        found[i] = idf
        return found

    def overlap(self, asked: list[tuple[str, float]]) -> dict[int, tuple[float, int]]:
        """Line → score and number of question words: how much of the question a line carries.

        A question word that stands in the line counts its idf. Otherwise the rarest word of the
        line that contains it or is contained in it counts 0.7 of its own idf (both two characters
        or more, numbers aside).
        """
        hit: dict[int, tuple[float, int]] = {}
        for word, idf in asked:
            gains = {i: near * PARTIAL for i, near in self._near(word).items()} if len(word) >= 2 else {}
            gains |= dict.fromkeys(self._lines.get(word, ()), 0.0 if idf is None else idf)
            for i, gain in gains.items():
                score, n = hit.get(i, (0.0, 0))
                hit[i] = score + gain, n + 1
        return hit


def _line_facts(item: Column, profile: Profile) -> Column:
    """What the score of a line owes to its text alone, as bits: heading, short first line, short, counted, and a
    bit for every question type whose lines look like it."""
    line = item["line"]
    first = (item["idx"] == 0) & (F.length(line) < SHORT_FIRST) & ~line.rlike("[0-9]")
    facts = [line.rlike(profile.heading), first, F.length(line) < SHORT, line.rlike(profile.counted),
             *[line.rlike(pattern) for pattern in profile.line_pref.values()]]
    out = F.lit(0)
    for bit, fact in enumerate(facts):
        out = out + F.when(fact, 1 << bit).otherwise(0)
    return out


def _line_scores(page: _Page, lines: list[str], facts: np.ndarray, sizes: np.ndarray, asked: list[tuple[str, float]],
                 raw: list[str], top_idf: float, pref: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all lines for one question, and how many of its words they have."""
    score, n, n_raw = np.zeros(len(lines)), np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    for i, (gain, words) in page.overlap(asked).items():
        score[i], n[i] = gain, words
    for key in raw:
        n_raw += np.fromiter((key in line for line in lines), bool, len(lines))
    n = n + n_raw
    bit = lambda at: (facts >> at) & 1 == 1
    score = score + RAW_WEIGHT * top_idf * n_raw + PER_MATCH * n
    if pref is not None:
        score = score + np.where((n > 0) & bit(4 + pref), TYPE_BONUS, 0.0)
    score = score - np.where(bit(0), HEADING_LOSS, 0.0)
    score = score - np.where(bit(1), SHORT_FIRST_LOSS, 0.0)
    score = score - np.where(bit(2), SHORT_LOSS, 0.0)
    score = score + np.where(bit(3), COUNTED_BONUS, 0.0)
    return np.round(score - LONG_LOSS * np.maximum(0, sizes - LONG), 9), n


def _rows_of(lists: pa.Array) -> list[slice]:
    """Where the values of each list stand in the flattened lists."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def _strings(lists: pa.Array) -> list[list[str]]:
    values = lists.flatten().to_pylist()
    return [values[some] for some in _rows_of(lists)]


def _weighted(lists: pa.Array) -> list[list[tuple[str, float]]]:
    values = lists.flatten()
    words, idf = (pc.struct_field(values, name).to_pylist() for name in ("word", "idf"))
    return [list(zip(words[some], idf[some])) for some in _rows_of(lists)]


BEST = "struct<score:double,n:int,idx:int,line:string,words:array<string>,keys:array<struct<word:string,idf:double>>>"
SCORED = "array<struct<score:double,n:int,idx:int>>"


def _over_pages(pages: DataFrame, name: str, kind: str, profile: Profile | None = None) -> DataFrame:
    """One row per question and page of :func:`question_pages` with a column ``name``: the ``best`` line, all
    lines ``scored``, or, without a profile, the lines' ``overlaps`` (all of at least one word)."""
    own = [f for f in pages.schema if f.name not in ("lines", "weights", "_asked")]
    asking = pages.schema["_asked"].dataType.elementType
    taken = [f for f in own if f.name not in asking.names]
    schema = T.StructType([*asking.fields, *taken]).add(name, T.DataType.fromDDL(kind))
    labels = list(profile.line_pref) if profile else []
    facts = F.transform("lines", lambda item: _line_facts(item, profile) if profile else F.lit(0))
    rows = pages.select(*[f.name for f in taken], "weights", "_asked", "lines", facts.alias("_facts"))
    scored = pa.list_(pa.struct([("score", pa.float64()), ("n", pa.int32()), ("idx", pa.int32())]))
    keys_of = pa.list_(pa.struct([("word", pa.string()), ("idf", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            done = []
            for at in range(whole.num_rows):
                done.append(of_page(whole.slice(at, 1)))
                if sum(some.num_rows for some in done) >= ASKED_PER_ROW or at + 1 == whole.num_rows:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done = []

    def of_page(row: pa.RecordBatch) -> pa.RecordBatch:
        asked = row["_asked"].flatten()
        lines = row["lines"].flatten()
        text, keys = pc.struct_field(lines, "line").to_pylist(), _strings(pc.struct_field(lines, "keys"))
        page = _Page(keys, _weighted(row["weights"])[0])
        bits = row["_facts"].flatten().to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, text), np.int64, len(text))
        words = _weighted(pc.struct_field(asked, "asked"))
        if profile is None:
            out = [[(score, n, i) for i, (score, n) in sorted(page.overlap(some).items())] for some in words]
        else:
            raw, top = _strings(pc.struct_field(asked, "raw")), pc.struct_field(asked, "top_idf").to_pylist()
            kinds = pc.struct_field(asked, "qtype").to_pylist()
            out = [_line_scores(page, text, bits, sizes, *one, labels.index(label) if label in labels else None)
                   for *one, label in zip(words, raw, top, kinds, strict=True)]
        if name != "best":
            if profile is not None:
                out = [zip(score.tolist(), n.tolist(), range(len(text))) for score, n in out]
            found = pa.array([[{"score": s, "n": n, "idx": i} for s, n, i in some] for some in out], scored)
        elif text:
            first = [int(np.argmax(score)) for score, _ in out]
            line = lines.take(pa.array(first, pa.int64()))
            weighed = [[{"word": w, "idf": page.idf[w]} for w in keys[i] if w in page.idf] for i in first]
            found = pa.StructArray.from_arrays([
                pa.array([score[i] for i, (score, _) in zip(first, out)], pa.float64()), pa.array([n[i] for i, (_, n) in zip(first, out)], pa.int32()),
                pa.array(first, pa.int32()), pc.struct_field(line, "line"), pc.struct_field(line, "words"), pa.array(weighed, keys_of)],
                ["score", "n", "idx", "line", "words", "keys"])
        else:
            found = None
        parent = pa.array(np.zeros(len(asked), np.int64))
        columns = [*[pc.struct_field(asked, c) for c in asking.names], *[row[f.name].take(parent) for f in taken]]
        if found is None:
            found = pa.nulls(len(asked), pa.struct([
                ("score", pa.float64()), ("n", pa.int32()), ("idx", pa.int32()), ("line", pa.string()), ("words", pa.list_(pa.string())), ("keys", keys_of)]))
        return pa.RecordBatch.from_arrays([*columns, found], names=schema.names)

    return rows.mapInArrow(run, schema)


def line_overlaps(pages: DataFrame) -> DataFrame:
    """Adds ``overlaps`` (``array<struct<score, n, idx>>``) to one row per question and page: how much of the question
    the lines carry that have one of its words."""
    return _over_pages(pages, "overlaps", SCORED)


def score_lines(pages: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Adds ``scored`` (``array<struct<score, n, idx>>``, all lines) to one row per question and page."""
    return _over_pages(pages, "scored", SCORED, profile)


def best_lines(pages: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Adds ``best`` (``score, n, idx, line, words, keys``) to one row per question and page: the first line with the
    highest score, null on a page without lines."""
    return _over_pages(pages, "best", BEST, profile)


def rerank_pages(picked: DataFrame) -> DataFrame:
    """Adds ``place``: pages by line score plus a bonus for the search rank, search rank on ties."""
    bonus = F.coalesce(F.try_element_at(F.array(*[F.lit(b) for b in RANK_BONUS]), F.col("rank")), F.lit(0.0))
    total = F.round(F.col("best.score") + bonus, 9)
    return top_n(picked.withColumn("total", total), ["qid"], [F.col("total").desc(), "rank"],
                 len(RANK_BONUS), "place")


def _idf_of(weights: Column, key: Column, default: float) -> Column:
    return F.coalesce(_get(F.filter(weights, lambda w: w["word"] == key))["idf"], F.lit(default))


def _first_by_key(words: Column) -> Column:
    """Words whose lower-cased form did not occur before."""
    return let(F.transform(words, lambda w: F.lower(w)), lambda keys: F.filter(
        words, lambda w, i: F.array_position(keys, F.lower(w)) == i + 1))


def _by_score(items: Column) -> Column:
    """``array<struct<w, score, pos>>`` → words, best first, stable."""
    order = F.array_sort(F.transform(items, lambda s: F.struct(
        (-s["score"]).alias("neg"), s["pos"].alias("pos"), s["w"].alias("w"))))
    return F.transform(order, lambda s: s["w"])


def line_keywords(words: Column, asked: Column, weights: Column, weak: Column | None = None,
                  profile: Profile = LATIN) -> Column:
    """Up to five words of the chosen line that the question did not say, numbers and words
    missed in practice first. ``weak`` is ``array<struct<fact, boost>>``."""
    said = F.transform(asked, lambda a: a["word"])
    fit = F.filter(words, lambda w: ~F.array_contains(said, F.lower(w)) & ~w.isin(*profile.stopwords)
                   & (~is_number(w) | useful_number(w)))

    def score(w: Column, i: Column) -> Column:
        value = _idf_of(weights, F.lower(w), 1.0) + F.when(is_number(w), NUMBER_BONUS).otherwise(0.0)
        if weak is not None:
            value = value + F.coalesce(_get(F.filter(weak, lambda f: f["fact"] == w))["boost"], F.lit(0.0))
        return F.struct(w.alias("w"), F.round(value, 9).alias("score"), i.alias("pos"))

    return F.slice(_by_score(F.transform(_first_by_key(fit), score)), 1, KEYWORDS_PER_LINE)


def key_facts(line: Column, words: Column, weights: Column, profile: Profile = LATIN) -> Column:
    """What an answer should have said: the line's useful numbers in order, then its rare whole
    words, six in all."""
    numbers = _first_by_key(F.filter(words, lambda w: is_number(w) & useful_number(w)))
    piece = lambda w: (F.rlike(line, F.concat(F.lit(r"[가-힣A-Za-z\-]\Q"), w, F.lit(r"\E")))
                       | F.rlike(line, F.concat(F.lit(r"\Q"), w, F.lit(r"\E[가-힣]"))))
    plain = F.filter(words, lambda w: ~is_number(w) & (F.length(w) >= 2)
                     & ~w.isin(*profile.stopwords, *profile.generic) & ~piece(w))
    scored = F.transform(_first_by_key(plain), lambda w, i: F.struct(
        w.alias("w"), F.round(_idf_of(weights, F.lower(w), 0.0), 9).alias("score"), i.alias("pos")))
    rest = _by_score(F.filter(scored, lambda s: s["score"] >= MIN_FACT_IDF))
    # numbers are never cut, words fill up to six
    return let(numbers, lambda ns: F.concat(ns, F.slice(rest, F.lit(1), F.greatest(F.lit(0), MAX_FACTS - F.size(ns)))))


def shown(line: Column) -> Column:
    return F.substring(F.regexp_replace(line, SHOWN_BULLET, ""), 1, SNIPPET)


def question_pages(hits: DataFrame, questions: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per hit page and some of the questions that hit it: the columns of ``pages`` and ``_asked``, what
    ``hits(qid, id, ...)`` and ``questions(qid, ...)`` say of each. A page comes again for every 256 of them or so."""
    pairs = hits.join(questions, "qid")
    blocks = hits.groupBy("id").agg(F.ceil(F.count("*") / ASKED_PER_ROW).alias("_blocks"))
    asked = pairs.join(blocks, "id").groupBy("id", F.pmod(F.hash("qid"), "_blocks").alias("_block")).agg(
        F.collect_list(F.struct(*pairs.columns)).alias("_asked"))
    return asked.drop("_block").join(pages, "id")


def evidence(hits: DataFrame, questions: DataFrame, pages: DataFrame, weak: DataFrame | None = None,
             profile: Profile = LATIN) -> DataFrame:
    """One row per question and hit page, in display order:
    ``qid, place, id, deck_id, page, snippet, refined, score, keywords``.

    ``questions`` is a :func:`question_context`, ``pages`` a :func:`page_context`, ``weak``
    ``deck_id, page, fact, boost`` from practice.
    """
    pairs = question_pages(hits.select("qid", "id", "rank"), questions, pages.drop("deck_id"))
    picked = rerank_pages(best_lines(pairs, profile).where(F.col("best").isNotNull()))
    if weak is None:
        picked = picked.withColumn("_weak", F.array().cast("array<struct<fact:string,boost:double>>"))
    else:
        boosts = weak.groupBy("deck_id", "page").agg(F.collect_list(F.struct("fact", "boost")).alias("_weak"))
        picked = picked.join(boosts, ["deck_id", "page"], "left").withColumn(
            "_weak", F.coalesce("_weak", F.array().cast("array<struct<fact:string,boost:double>>")))
    keywords = line_keywords(F.col("best.words"), F.col("asked"), F.col("best.keys"), F.col("_weak"), profile)
    return picked.select("qid", "place", "id", "deck_id", "page", shown(F.col("best.line")).alias("snippet"),
                         F.col("from_refined").alias("refined"), F.col("total").alias("score"),
                         keywords.alias("keywords"))


def gather_sources(found: DataFrame) -> DataFrame:
    """One row per question: ``sources`` in display order and the merged ``keywords`` (six)."""
    rows = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(
        "place", "page", "snippet", "deck_id", "refined", "keywords"))).alias("_rows"))
    merged = F.slice(F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["keywords"]))), 1, KEYWORDS)
    sources = F.transform("_rows", lambda r: F.struct(
        r["page"].alias("slide"), r["snippet"].alias("snippet"), r["deck_id"].alias("source"),
        r["refined"].alias("refined")))
    return rows.select("qid", sources.alias("sources"), merged.alias("keywords"))


def match_texts(texts: DataFrame, questions: DataFrame, vocab: DataFrame, words: Words = content_words) -> DataFrame:
    """Word overlap of questions with short texts of the same deck: ``qid, id, score, n``.

    ``texts(deck_id, id, text)``. Candidates come from word equality or a shared two-character
    stretch inside the same deck, so only texts that can match meet the question.

    Spark takes the rows of an exploded array for as few as the arrays, and would broadcast words and
    stretches of whole tables; the joins on them are therefore asked to shuffle.
    """
    own = F.array_distinct(F.transform(words(F.col("text")), lambda w: F.lower(w)))
    base = texts.select("deck_id", "id", own.alias("keys"))
    weights = stored(base.select("deck_id", "id", F.explode_outer("keys").alias("word")).where(F.col("word").isNotNull())
                     .join(vocab.select("deck_id", "word", "idf").hint("merge"), ["deck_id", "word"], "left")
                     .withColumn("idf", F.coalesce("idf", F.lit(0.0))), "text-words")
    asked = stored(questions.select("qid", "deck_id", F.explode("asked").alias("_a")).select(
        "qid", "deck_id", F.col("_a.word").alias("q"), F.col("_a.idf").alias("q_idf")), "asked-words")
    pairs = word_pairs(weights.select("deck_id", "word").distinct(), asked.select("deck_id", "q").distinct())
    # one row per question word and text: the word itself if present, else the best partner
    hit = (asked.join(pairs.hint("merge"), ["deck_id", "q"]).join(weights.hint("merge"), ["deck_id", "word"])
           .groupBy("qid", "id", "q").agg(
               F.max(F.when(F.col("word") == F.col("q"), F.coalesce("q_idf", F.lit(0.0)))).alias("exact"),
               F.max(F.when(F.col("word") != F.col("q"), PARTIAL * F.col("idf"))).alias("near")))
    return hit.groupBy("qid", "id").agg(
        F.round(F.sum(F.coalesce("exact", "near", F.lit(0.0))), 9).alias("score"), F.count("*").alias("n"))


def word_pairs(words: DataFrame, asked: DataFrame) -> DataFrame:
    """Vocabulary pairs ``deck_id, word, q`` where one contains the other.

    The shorter word is a substring of the longer one, so it equals one of the longer word's
    stretches of that length: an equi-join on the stretch, both ways round, instead of a
    nested loop. Words are short, so stretches per word are few.
    """
    def stretches(word: Column) -> Column:
        n = F.length(word)
        return F.when(n >= 2, F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda start: F.transform(F.sequence(F.lit(2), F.greatest(n - start + 1, F.lit(2))),
                                      lambda size: F.substring(word, start, size)))))).otherwise(
            F.array().cast("array<string>"))

    ws = words.where((F.length("word") >= 2) & ~is_number(F.col("word")))
    qs = asked.where(F.length("q") >= 2)
    inner = ws.join(qs.select("deck_id", "q", F.explode(stretches(F.col("q"))).alias("word")).hint("merge"), ["deck_id", "word"])
    outer = qs.join(ws.select("deck_id", "word", F.explode(stretches(F.col("word"))).alias("q")).hint("merge"), ["deck_id", "q"])
    same = words.join(asked.select("deck_id", "q", F.col("q").alias("word")).hint("merge"), ["deck_id", "word"])
    pick = lambda df: df.select("deck_id", "word", "q")
    return pick(inner).unionByName(pick(outer)).unionByName(pick(same)).distinct()


def best_texts(matched: DataFrame, texts: DataFrame, n: int = GENERAL_NOTES) -> DataFrame:
    """The n best matching texts per question, earlier text first on ties: ``texts(id, ord, text)``."""
    return top_n(matched.join(texts.select("id", "ord", "text").hint("merge"), "id"), ["qid"],
                 [F.col("score").desc(), "ord"], n)


def fallback_evidence(base: DataFrame, picked: DataFrame, questions: DataFrame, pages: DataFrame, label: str = "") -> DataFrame:
    """``qid, page, text``: found pages with the pages and general notes that stand in, for questions that gain by it.

    ``base(qid, page, text)`` is what the search found (page 0: general text), ``picked`` are
    :func:`fallback_notes`, ``questions(qid, deck_id)``, ``pages(deck_id, page, text)`` one row a page. Pages of picked notes
    join those of the base, general notes make page 0 in their order. A question to which neither a page nor another
    general text is added gets no rows, as asking again would give the same answer, nor does one without notes.
    """
    tied = F.coalesce("page", F.lit(0)) != 0
    found = base.where(tied).select("qid", "page", F.col("text").alias("_old"))
    named = picked.where(tied).select("qid", "page").distinct().join(questions.select("qid", "deck_id"), "qid").join(
        pages.select("deck_id", "page", F.col("text").alias("_new")), ["deck_id", "page"]).select("qid", "page", "_new")
    merged = found.join(named, ["qid", "page"], "full_outer").select("qid", "page", F.coalesce("_old", "_new").alias("text"), F.col("_old").isNull().alias("_added"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit(label), x["text"]))
    general = picked.where(~tied).groupBy("qid").agg(F.array_join(lines, "\n").alias("text"))
    before = base.where(~tied).select("qid", F.col("text").alias("_old"))
    other = general.join(before, "qid", "full_outer").where(~F.col("text").eqNullSafe(F.col("_old"))).select("qid")
    gains = merged.where("_added").select("qid").unionByName(other).distinct().join(picked.select("qid").distinct(), "qid", "left_semi")
    whole = merged.select("qid", "page", "text").unionByName(general.select("qid", F.lit(0).alias("page"), "text"))
    return whole.join(gains, "qid", "left_semi")


def fallback_notes(matched: DataFrame, questions: DataFrame, notes: DataFrame, n: int = FALLBACK_NOTES) -> DataFrame:
    """Notes that stand in when the slides have no answer: matching ones by score, then the
    deck's first ones, n per question."""
    leading = top_n(notes, ["deck_id"], ["ord"], n, "_lead").select("deck_id", "id", "ord", "page", "text")
    filler = questions.select("qid", "deck_id").join(leading.hint("merge"), "deck_id").withColumn("score", F.lit(0.0))
    hit = matched.join(notes.select("id", "deck_id", "ord", "page", "text").hint("merge"), "id")
    cols = ["qid", "id", "ord", "page", "text", "score"]
    both = hit.select(*cols).unionByName(filler.select(*cols)).groupBy("qid", "id", "ord", "page", "text").agg(
        F.max("score").alias("score"))
    return top_n(both, ["qid"], [F.col("score").desc(), "ord"], n)
