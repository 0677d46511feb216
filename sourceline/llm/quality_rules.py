"""Quality rules: a threshold table, compiled into one projection of ratios of a text.

A rule is ``Rule(name, part, whole, least, most)``: 100 times the measure ``part`` must lie between
``least`` and ``most`` times the measure ``whole``. ``compiled`` turns a table of rules into one Column, so a
table costs one pass over the texts whatever it holds, with no user function, shuffle or join, and other
tables are only data. Comparisons are of whole numbers: no verdict hangs on rounding.

The measures of a text are exact at any length. Words in repeated 3-word windows are found by sorting the
windows of the text and comparing neighbours, so a text costs n log n.

Defined cases: a null text has no words, like an empty one; a text of fewer than three words has no window;
a line counts if it has a word, and equal lines are equal byte by byte; a rule whose ``whole`` is 0 asks
that ``part`` be 0 or ``least`` not be positive; a text without words passes every ratio and fails the number of
words; rows that repeat an id are judged each by itself; an empty table gives no rows; other columns are
not read by the verdicts and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, numbered


class Rule(NamedTuple):
    """``least`` and ``most`` in hundredths of ``whole``; None: no bound."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


# The base rules of the contract, frequent short words of four languages, symbols and quotes.
SYMBOLS = "[#*$%&|<>]"
BASE = (Rule("few_words", "n_words", "one", 5000, None), Rule("repeated_words", "n_repeat_words", "n_words", None, 50))
STOP_WORDS = {
    "de": "als an auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "en": "a and are as at be by for from in is it not of on or that the this to was with",
    "es": "al como con de del el en es la las lo los más no para por que se su un una y",
    "fr": "au avec dans de des du en est et la le les par pas pour que qui sur un une",
}
EDGE = ".,;:!?\"'()"
# End of fixed values.

#: Ratios that prose keeps by a margin. The 3,243 documents of sf0.1 that ``labels`` marks good and that have 50
#: words lie at 4.2 to 6.3 characters a word, no symbol, 13 % stop words or more, 5 % capitals or less, 82 %
#: letters or more and 33 % duplicate lines or less; of the 548 marked bad none keeps all rules.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop", "n_words", 6, None),
    Rule("capitals", "n_capitals", "n_letters", None, 30),
    Rule("letters", "n_letters", "word_chars", 70, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_capitals", "n_letters")


def forms(words: dict[str, str]) -> list[str]:
    """Every word in small letters, with a capital first, and in capitals."""
    return sorted({f for w in " ".join(words.values()).split() for f in (w, w.capitalize(), w.upper())})


def measured(df: DataFrame, text: Column, stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """``df`` with the struct ``measures`` of ``text``: three projections, each reading what the last made."""
    texts = df.withColumn("_text", F.coalesce(text, F.lit("")))
    parts = texts.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)))
    n = F.size("_words")
    windows = F.arrays_zip(*[F.slice("_words", F.lit(k), F.greatest(n - 2, F.lit(0))) for k in (1, 2, 3)], F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))))
    # sorted windows are used twice below, so the projection that sorts them stands by itself
    windowed = parts.withColumn("_windows", F.when(n > 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<`0`:string,`1`:string,`2`:string,`3`:int>>")))
    m = F.greatest(F.size("_windows") - 1, F.lit(0))

    def covered(x: Column, y: Column) -> Column:
        same = (x["0"] == y["0"]) & (x["1"] == y["1"]) & (x["2"] == y["2"])
        return F.when(same, F.array(*[w["3"] + k for w in (x, y) for k in range(3)]))

    pairs = F.zip_with(F.slice("_windows", F.lit(1), m), F.slice("_windows", F.lit(2), m), covered)
    repeats = F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda at: at.isNotNull()))))
    chars = F.length(F.array_join("_words", ""))
    stop = F.size(F.filter("_words", lambda w: F.btrim(w, F.lit(EDGE)).isin(forms(stop_words))))
    values = {
        "n_words": F.size("_words"), "word_chars": chars, "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": repeats, "n_lines": F.size("_lines"),
        "n_stop": stop, "n_capitals": F.regexp_count("_text", F.lit("[A-Z]")),
        "n_letters": chars - F.regexp_count("_text", F.lit(r"[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]")),
    }
    measures = F.struct(*[values[k].cast("long").alias(k) for k in MEASURES])
    return windowed.withColumn("measures", measures).drop("_text", "_words", "_lines", "_windows")


def broken(rule: Rule, measures: Column) -> Column:
    """True where ``measures`` lie outside a rule."""
    value = lambda name: F.lit(1).cast("long") if name == "one" else measures[name]
    part, whole = value(rule.part) * 100, value(rule.whole)
    low = F.lit(False) if rule.least is None else part < whole * rule.least
    return low if rule.most is None else low | (part > whole * rule.most)


def compiled(rules: Sequence[Rule], measures: Column) -> Column:
    """The names of the rules that ``measures`` break, comma-joined, as one Column."""
    return F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(broken(r, measures), F.lit(r.name)) for r in rules])), ",")


def verdicts(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id``, the measures of the contract, ``base_failed``, ``kept`` and ``failed``, the names of all broken rules."""
    m = F.col("measures")
    judged = measured(docs.select("doc_id", "text"), F.col("text")).select(
        "doc_id", *[m[k].alias(k) for k in MEASURES[:5]], reduce(Column.__or__, [broken(r, m) for r in BASE]).alias("base_failed"), compiled([*BASE, *rules], m).alias("failed"))
    return judged.select("doc_id", *MEASURES[:5], "base_failed", (F.col("failed") == "").alias("kept"), "failed")


def accepted(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that break no rule, with their own columns."""
    return measured(numbered(docs), F.col("doc.text")).where(compiled([*BASE, *rules], F.col("measures")) == "").select("doc.*")


_PART = {
    "n_words": "len(w)", "word_chars": "length(array_to_string(w, ''))", "n_symbols": f"len(regexp_extract_all(t, '{SYMBOLS}'))",
    "n_dup_lines": "len(lines) - len(list_distinct(lines))", "n_repeat_words": "coalesce(r.n, 0)", "n_lines": "len(lines)",
    "n_stop": "len(list_filter(w, lambda x: trim(x, '{edge}') in ({forms})))".format(
        edge=EDGE.replace("'", "''"), forms=", ".join(f"'{f}'" for f in forms(STOP_WORDS))),
    "n_capitals": "len(regexp_extract_all(t, '[A-Z]'))",
    "n_letters": r"length(array_to_string(w, '')) - len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]'))",
}


def _sql(rule: Rule) -> str:
    part, whole = f"100 * {rule.part}", "1" if rule.whole == "one" else rule.whole
    return " or ".join(([f"{part} < {whole} * {rule.least}"] if rule.least is not None else []) + ([f"{part} > {whole} * {rule.most}"] if rule.most is not None else []))


ORACLE = rf"""
with d as (select row_number() over () id, doc_id, coalesce(text, '') t from documents),
s as (select *, regexp_extract_all(t, '{WORD}') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) lines from d),
g as (select id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select id, w, unnest(range(1, len(w) - 1)) i from s)),
r as (select id, count(distinct p) n from (select id, unnest([i, i + 1, i + 2]) p from (select *, count(*) over (partition by id, g) c from g) where c > 1) group by id),
m as (select doc_id, {", ".join(f"{sql} {name}" for name, sql in _PART.items())} from s left join r using (id)),
f as (select *, array_to_string(list_filter([{", ".join(f"case when {_sql(x)} then '{x.name}' end" for x in (*BASE, *RULES))}], lambda x: x is not null), ',') failed from m)
select doc_id, {", ".join(MEASURES[:5])}, {" or ".join(f"({_sql(x)})" for x in BASE)} base_failed, failed = '' kept, failed from f
"""
