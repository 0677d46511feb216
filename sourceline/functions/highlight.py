"""Spans to highlight in a text: ``array<struct<start, end>>``, zero-based, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import find_all, let

# ---- fixed values -------------------------------------------------------------------
WORD_CHAR = "[가-힣ㄱ-ㅎㅏ-ㅣa-zA-Z0-9]"
NUMBER_WITH_UNIT = r"(?<![A-Za-z0-9])[0-9][0-9,.~]*(?![A-Za-z])\s*(?:%|배|[가-힣]{1,2}(?=[\s,.)]|$))?"
# -------------------------------------------------------------------------------------

SPANS = "array<struct<start:int,end:int>>"


def _from_pieces(pieces: Column, lengths: Column) -> Column:
    """Spans of the matches between split pieces, given the length of every match."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = (acc["at"] + F.length(pair["piece"])).cast("int")
        end = (begin + F.coalesce(pair["size"], F.lit(0))).cast("int")
        return F.struct(end.alias("at"), F.when(pair["size"].isNotNull(), F.concat(
            acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(pieces, lengths, lambda p, n: F.struct(F.coalesce(p, F.lit("")).alias("piece"), n.alias("size")))
    return F.aggregate(pairs, start, step)["out"]


def occurrences(text: Column, word: Column) -> Column:
    """Every occurrence from left to right, not overlapping itself."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")), -1)
    return let(pieces, lambda ps: _from_pieces(ps, F.transform(F.slice(ps, 2, 1_000_000_000), lambda _: F.length(word))))


def numbers_with_units(text: Column) -> Column:
    def spans(found: Column) -> Column:
        return F.zip_with(_from_pieces(F.split(text, NUMBER_WITH_UNIT, -1), F.transform(found, F.length)), found, lambda s, n: F.struct(
            s["start"].alias("start"), (s["start"] + F.length(F.rtrim(n))).cast("int").alias("end")))

    return let(find_all(text, NUMBER_WITH_UNIT), spans)


def _without_overlaps(spans: Column) -> Column:
    """Spans by start; one that begins inside the span before it goes."""
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("out")))
    order = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"))))
    return F.aggregate(order, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), step)["out"]


def word_and_number_spans(text: Column, words: Column) -> Column:
    """Words that start at a word boundary, painted to the end of the written word, and numbers
    with their units; of overlapping spans the first stays."""
    def of_word(word: Column) -> Column:
        """Judged by the stretches between the occurrences, so the text is read once however many there are."""
        head = lambda t: F.length(F.regexp_extract(t, f"^({WORD_CHAR}*)", 1))
        begins, ends = head(word), F.substring(word, -1, 1).rlike(WORD_CHAR)

        def step(acc: Column, row: Column) -> Column:
            # characters of the written word behind an occurrence may go on through the next ones
            on = F.when((row["own"] == F.length(row["after"])) & acc["next"].isNotNull(), begins + F.when(
                begins == F.length(word), acc["next"]).otherwise(0)).otherwise(0)
            first = F.when(row["before"] != "", ~F.substring(row["before"], -1, 1).rlike(WORD_CHAR)).otherwise((row["start"] == 0) | ~ends)
            return let(row["own"] + on, lambda run: F.struct(run.alias("next"), F.when(first, F.concat(
                F.array(F.struct(row["start"].alias("start"), (row["end"] + run).cast("int").alias("end"))), acc["out"])).otherwise(acc["out"]).alias("out")))

        def spans(pieces: Column) -> Column:
            found = _from_pieces(pieces, F.transform(F.slice(pieces, 2, 1_000_000_000), lambda _: F.length(word)))
            rows = F.transform(found, lambda s, i: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after"),
                head(F.get(pieces, i + 1)).alias("own")))
            start = F.struct(F.lit(None).cast("int").alias("next"), F.array().cast(SPANS).alias("out"))
            return F.aggregate(F.reverse(rows), start, step)["out"]

        return let(F.split(text, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")), -1), spans)

    long_words = F.filter(words, lambda w: F.length(w) >= 2)
    return let(F.concat(F.flatten(F.transform(long_words, of_word)), numbers_with_units(text)), _without_overlaps)


def literal_spans(text: Column, words: Column) -> Column:
    """Literal occurrences; where two words overlap the longer word wins."""
    by_length = F.transform(F.array_sort(F.transform(F.filter(words, lambda w: F.length(w) >= 2), lambda w, i: F.struct(
        (-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), lambda s: s["w"])
    add = lambda acc, s: F.when(F.exists(acc, lambda o: (s["start"] < o["end"]) & (s["end"] > o["start"])), acc).otherwise(
        F.concat(acc, F.array(s)))
    return F.array_sort(F.aggregate(F.flatten(F.transform(by_length, lambda w: occurrences(text, w))),
                                    F.array().cast(SPANS), add))
