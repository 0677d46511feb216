"""Quality rules, against loops over the words of a text."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from sourceline.llm import quality_rules as rules

from .conftest import odd_rows

WORDS, WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]")


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    n, chars = len(words), sum(map(len, words))
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p for i in range(n - 2) if grams[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    stop = sum(w.strip(".,;:!?\"'()") in set(rules.forms(rules.STOP_WORDS)) for w in words)
    capitals = sum("A" <= c <= "Z" for c in text)
    letters = sum(c.isascii() and c.isalpha() or not c.isascii() for w in words for c in w)
    base = [n < 50 and "few_words", 100 * len(covered) > 50 * n and "repeated_words"]
    symbols, again = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    more = [chars < 2 * n or chars > 12 * n, 10 * symbols > n, 100 * stop < 6 * n, 100 * capitals > 30 * letters, 100 * letters < 70 * chars, 2 * again > len(lines)]
    failed = [*filter(None, base), *[r.name for r, bad in zip(rules.RULES, more, strict=True) if bad]]
    return n, chars, symbols, again, len(covered), any(base), not failed, ",".join(failed)


MORE = ["a b c d", "a b c a b c", "a b a b a b a", "x x x", "a b c\na b c\n\na b c \n \n", "#*$%&|<>" * 9, "The THE the (the) the. 'the' thé",
        "the line is of it\n" * 30, "of this and that " * 40 + "WORDS " * 80, "π" * 40 + " \x0b\f\r\x85 　" + "a" * 900, "\x00\x01 a \n\n\x1f",
        " ".join(f"{chr(97 + i % 26)}{'oe' * (1 + i // 26)} of" for i in range(60)), " ".join(f"w{i} of the" for i in range(60)) + " # | <" * 7]


def key(found):
    return sorted(found, key=repr)


def test_verdicts_equal_loops(spark, odd, none):
    texts = [(r[0], r[1]) for r in odd_rows()]
    assert key(map(tuple, rules.verdicts(odd).collect())) == key((i, *plain(t)) for i, t in texts)
    more = spark.createDataFrame([(i, t, "odd", "odd") for i, t in enumerate(MORE)], "doc_id long, text string, measures string, _words string")
    got = key(map(tuple, rules.verdicts(more).collect()))
    assert got == key((i, *plain(t)) for i, t in enumerate(MORE)) and {g[-2] for g in got} == {True, False}
    assert rules.verdicts(none).count() == 0 and rules.accepted(none).count() == 0


def test_accepted_keeps_whole_documents(odd):
    kept = rules.accepted(odd)
    assert kept.columns == odd.columns
    assert key((r.doc_id, r.text) for r in kept.collect()) == key((r[0], r[1]) for r in odd_rows() if plain(r[1])[-2])


def test_a_table_is_data(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a # b c"), (3, None)], "doc_id long, text string")
    table = (rules.Rule("symbols", "n_symbols", "n_words", 1, 25), rules.Rule("nothing", "n_words", "n_lines", None, None))
    assert [r.failed for r in rules.verdicts(df, table).orderBy("doc_id").collect()] == ["few_words,symbols", "few_words", "few_words"]
    assert [r.failed for r in rules.verdicts(df, ()).orderBy("doc_id").collect()] == ["few_words"] * 3


def test_one_projection(spark):
    plan = rules.verdicts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Arrow", "Pandas", "Join", "Aggregate"))


@pytest.mark.parametrize("sf", ["0.01"])
def test_labelled_documents(spark, sf):
    labels = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet")
    rows = rules.verdicts(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) == len(rows) > 300
