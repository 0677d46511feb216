"""Text projections as Columns. Everything here stays inside the JVM.

``\\s`` is ASCII-only in Java, so blanks are written as ``[\\s\\p{Z}]``, which also
covers no-break and ideographic spaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}]"
EDGE_BLANK = rf"^{BLANK}+|{BLANK}+$"

# ---- fixed values -------------------------------------------------------------------
NOTE_MARK = "\n\n[노트] "
LEXICAL_TOKEN = r"[0-9][0-9,.]*|[a-z]+|[가-힣]+"
CONTENT_WORD = r"[0-9]+(?:[.,][0-9]+)*(?:%|㎡|℃|[가-힣]{1,2})?|\p{L}+[0-9]{0,2}"
FREE_DIGIT = r"(^|[^A-Za-z])[0-9]([^A-Za-z]|$)"
UNIT = "%|곳|명|인|개|건|원|억|만|년|월|일|배|회|장|차|위|종|시간|분|초|점|퍼센트"
BULLET = r"^\s*([-•▪◦●○■□※➢❖✓›]|\d+[.)]|[①-⑳]|STEP\s)"
SHOWN_BULLET = r"^[-•▪◦●○■□※➢❖✓]\s*"
REFINED_MARK = r"^\s*(?:#+\s*|[-•*]\s*)"
HEADING_LINE = r"^\s*(?:#{1,6}\s+.+|[0-9]{1,2}[.)]\s*[^.!?。]{1,40}|[■□▶◆●]\s*.{1,40})\s*$"
LETTER = "[가-힣A-Za-z]"
LABEL_MAX, VALUE_MAX, LINE_MIN = 25, 20, 6
MAX_JOINED, MIN_NEXT, MIN_NEXT_AFTER_COMMA = 150, 8, 3
PASSAGE_WINDOW, PASSAGE_STRIDE = 220, 110
PART_MAX = 3500
HEADING_MAX = 50
# -------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_BLANK, "")


def squeeze(text: Column) -> Column:
    """Without blanks and thousands commas: the form numbers are compared in."""
    return F.regexp_replace(text, rf"{BLANK}|,", "")


def fold(text: Column) -> Column:
    """Squeezed and lower-cased: the form facts are compared in."""
    return F.lower(squeeze(text))


def tidy_whitespace(text: Column) -> Column:
    text = F.regexp_replace(F.translate(text, " ", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def with_notes(body: Column, notes: Column) -> Column:
    """Body followed by the speaker notes under a marker, when there are any."""
    return F.when(F.coalesce(notes, F.lit("")) == "", body).otherwise(
        F.concat(body, F.lit(NOTE_MARK), notes))


def body_part(text: Column) -> Column:
    at = F.instr(text, NOTE_MARK)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def notes_part(text: Column) -> Column:
    at = F.instr(text, NOTE_MARK)
    return F.when(at > 0, F.substring(text, at + len(NOTE_MARK), F.length(text))).otherwise(F.lit(""))


def misses_spaces(text: Column, letter: str = "가-힣", min_letters: int = 30, min_ratio: float = 0.05) -> Column:
    letters = count_of(text, f"[{letter}]")
    gaps = count_of(text, f"[{letter}] (?=[{letter}])")
    return (letters >= min_letters) & (gaps / letters < min_ratio)


def attach_units(text: Column, units: str = UNIT) -> Column:
    return F.regexp_replace(text, rf"([0-9])\s+({units})", "$1$2")


def split_lines(text: Column) -> Column:
    """Stripped, non-blank lines in order."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def join_wrapped(text: Column, open_end: str) -> Column:
    """Put lines back together that a narrow text box had wrapped.

    ``open_end`` is the regex that says a line cannot end a sentence. The fold keeps the
    finished lines as one string and the current line beside it, so nothing grows per step
    but the two strings.
    """
    def step(acc: Column, raw: Column) -> Column:
        nxt = strip(raw)
        held = F.regexp_replace(acc["open"], rf"{BLANK}+$", "")
        comma = held.endswith(",")
        needed = F.when(comma, F.lit(MIN_NEXT_AFTER_COMMA)).otherwise(F.lit(MIN_NEXT))
        joins = (acc["any"] & (nxt != "") & ~matches(nxt, BULLET)
                 & (F.length(F.regexp_replace(nxt, BLANK, "")) >= needed)
                 & (F.length(acc["open"]) + F.length(nxt) < MAX_JOINED)
                 & (comma | matches(held, open_end)))
        return F.struct(
            F.when(joins | ~acc["any"], acc["done"])
             .otherwise(F.concat(acc["done"], acc["open"], F.lit("\n"))).alias("done"),
            F.when(joins, F.concat(held, F.lit(" "), nxt)).otherwise(raw).alias("open"),
            F.lit(True).alias("any"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"), F.lit(False).alias("any"))
    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.concat(acc["done"], acc["open"]))


def candidate_lines(text: Column) -> Column:
    """Evidence candidates: lines over six characters, and short label lines merged with
    the short value line below them. ``array<struct<pos, part, line>>`` in display order."""
    raw = split_lines(text)
    paired = F.zip_with(raw, F.slice(raw, 2, 1_000_000_000), lambda line, below: F.struct(
        line.alias("line"), below.alias("below")))

    def expand(pair: Column, pos: Column) -> Column:
        labelled = ((F.length(pair["line"]) <= LABEL_MAX) & ~matches(pair["line"], FREE_DIGIT)
                    & (F.length(pair["below"]) <= VALUE_MAX) & matches(pair["below"], FREE_DIGIT))
        own = F.struct(pos.alias("pos"), F.lit(0).alias("part"),
                       F.when(F.length(pair["line"]) > LINE_MIN, pair["line"]).alias("line"))
        merged = F.struct(pos.alias("pos"), F.lit(1).alias("part"),
                          F.when(labelled, F.concat_ws(" ", pair["line"], pair["below"])).alias("line"))
        return F.array(own, merged)

    return F.filter(F.flatten(F.transform(paired, expand)), lambda c: c["line"].isNotNull())


def refined_lines(text: Column) -> Column:
    """Candidates from cleaned-up text: marks and list numbers off, same output shape."""
    def clean(raw: Column, pos: Column) -> Column:
        line = strip(F.regexp_replace(raw, REFINED_MARK, ""))
        line = F.regexp_replace(line, r"^(?:0[0-9]|[0-9]{1,2})[.)]?\s+(.{12,})$", "$1")
        return F.struct(pos.alias("pos"), F.lit(0).alias("part"), line.alias("line"))

    return F.filter(F.transform(F.split(text, "\n"), clean), lambda c: F.length(c["line"]) > LINE_MIN)


def _adjacent_pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))


def lexical_tokens(text: Column) -> Column:
    """Numbers whole, Latin runs, Hangul runs with their character pairs; repeats kept."""
    found = find_all(F.lower(text), LEXICAL_TOKEN)
    with_pairs = F.flatten(F.transform(found, lambda t: F.when(
        matches(t, "^[가-힣]{2}"), F.concat(F.array(t), _adjacent_pairs(t))).otherwise(F.array(t))))
    return F.when(matches(text, "[가-힣]{2}"), with_pairs).otherwise(found)


def content_words(text: Column, one_char_skip: tuple[str, ...] = ()) -> Column:
    """Default word extractor: numbers with their unit, names with a trailing digit or two,
    and words. Single letters go, single Hangul syllables stay unless they are in the skip
    list. A language analyzer can be passed instead wherever this is used."""
    keep = lambda w: (F.length(w) >= 2) | matches(w, "^[0-9]") | (
        matches(w, "^[가-힣]$") & ~w.isin(*one_char_skip) if one_char_skip else matches(w, "^[가-힣]$"))
    return F.filter(find_all(text, CONTENT_WORD), keep)


def is_number(word: Column) -> Column:
    return matches(word, "^[0-9]")


def useful_number(word: Column) -> Column:
    """Page and list numbers are bare and short; evidence numbers carry a unit or digits."""
    return matches(word, r"[,.]|%|[0-9]{4,}") | matches(word, r"^[0-9]+[^0-9]")


def bigrams(text: Column) -> Column:
    """Distinct adjacent character pairs, blanks ignored; empty below two characters."""
    tight = F.regexp_replace(text, f"{BLANK}+", "")
    # a look-ahead capture yields every overlapping pair in one pass over the text
    pairs = F.regexp_extract_all(tight, F.lit(r"(?s)(?=(..))."), F.lit(1))
    return F.array_distinct(F.filter(pairs, lambda p: p != ""))


def content_only(text: Column) -> Column:
    return F.regexp_replace(text, r"""[\s\p{Z}#*>\-|`"'.,()]""", "")


def passages(text: Column, window: int = PASSAGE_WINDOW, stride: int = PASSAGE_STRIDE) -> Column:
    """Overlapping windows of whole lines for passage scoring.

    A window closes with the line that brings it to ``window`` characters; the last lines
    that reach ``stride`` characters open the next one.
    """
    rows = F.filter(F.split(text, "\n"), lambda line: matches(line, r"[^\s\p{Z}]"))

    def tail(lines: Column) -> Column:
        back = F.aggregate(
            F.reverse(lines), F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n")),
            lambda acc, line: F.when(acc["n"] >= stride, acc).otherwise(F.struct(
                F.concat(F.array(line), acc["kept"]).alias("kept"), (acc["n"] + F.length(line)).alias("n"))))
        return back

    def step(acc: Column, line: Column) -> Column:
        lines = F.concat(acc["cur"], F.array(line))
        n = acc["n"] + F.length(line)
        kept = tail(lines)
        return F.when(n >= window, F.struct(
            F.concat(acc["out"], F.array(F.array_join(lines, "\n"))).alias("out"),
            kept["kept"].alias("cur"), kept["n"].alias("n"))
        ).otherwise(F.struct(acc["out"].alias("out"), lines.alias("cur"), n.alias("n")))

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("cur"), F.lit(0).alias("n"))
    folded = F.aggregate(rows, start, step, lambda acc: F.when(
        F.size(acc["cur"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["cur"], "\n")))).otherwise(acc["out"]))
    return F.when(F.size(folded) > 0, folded).otherwise(F.array(text))


def budget_parts(text: Column, limit: int = PART_MAX) -> Column:
    """Long text cut at blank lines into parts of about ``limit`` characters."""
    def step(acc: Column, para: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(para) > limit) & (acc["cur"] != "")
        piece = F.concat(para, F.lit("\n\n"))
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"),
            F.when(full, piece).otherwise(F.concat(acc["cur"], piece)).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    return F.aggregate(F.split(text, r"\n\s*\n"), start, step, lambda acc: F.when(
        matches(acc["cur"], r"[^\s\p{Z}]"), F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))


def first_long_line(text: Column, min_chars: int = 2, max_chars: int = 40) -> Column:
    found = F.filter(split_lines(text), lambda line: F.length(line) >= min_chars)
    return F.substring(F.get(found, F.lit(0)), 1, max_chars)


def letter_count(text: Column, letter: str = LETTER) -> Column:
    return count_of(text, letter)


def top_char_count(chars: Column) -> Column:
    """Occurrences of the most frequent character: the longest run of the sorted characters."""
    runs = find_all(F.array_join(F.sort_array(chars), ""), r"(?s)(.)\1*")
    return F.coalesce(F.array_max(F.transform(runs, lambda run: F.length(run))), F.lit(0))


def line_garbled(line: Column, alphabet: str = "[가-힣]") -> Column:
    chars = find_all(line, alphabet)
    n = F.size(chars)
    return (n >= 2) & ((F.size(F.array_distinct(chars)) / n < 0.5) | (top_char_count(chars) / n > 0.4))


def first_readable_line(text: Column, alphabet: str = "[가-힣]", letter: str = LETTER,
                        max_chars: int | None = None) -> Column:
    """The first line whose characters are not one syllable over and over, else the first line."""
    rows = split_lines(text)
    good = F.filter(rows, lambda line: (count_of(line, letter) >= 2) & ~line_garbled(line, alphabet))
    picked = F.coalesce(F.get(good, F.lit(0)), F.get(rows, F.lit(0)), F.lit(""))
    return F.substring(picked, 1, max_chars) if max_chars else picked


def is_heading(line: Column) -> Column:
    return matches(line, HEADING_LINE) & (F.length(strip(line)) <= HEADING_MAX)


def sections(text: Column) -> Column:
    """Paragraphs with the heading above them: ``array<struct<heading, body>>``.

    A heading line closes the paragraph before it and names what follows, across blank
    lines, until the next heading.
    """
    fields = "array<struct<heading:string,body:string>>"

    def close(acc: Column) -> Column:
        return F.when(acc["body"] != "", F.concat(acc["out"], F.array(F.struct(
            acc["heading"].alias("heading"), acc["body"].alias("body"))))).otherwise(acc["out"])

    def step(acc: Column, line: Column) -> Column:
        blank = ~matches(line, r"[^\s\p{Z}]")
        head = is_heading(line)
        tight = strip(line)
        return F.struct(
            F.when(blank | head, close(acc)).otherwise(acc["out"]).alias("out"),
            F.when(~blank & head, strip(F.regexp_replace(tight, "^#+", ""))).otherwise(acc["heading"]).alias("heading"),
            F.when(blank | head, F.lit("")).when(acc["body"] == "", tight)
             .otherwise(F.concat_ws(" ", acc["body"], tight)).alias("body"))

    start = F.struct(F.array().cast(fields).alias("out"), F.lit("").alias("heading"), F.lit("").alias("body"))
    return F.aggregate(F.split(text, "\n"), start, step, close)


def content_id(kind: Column, page: Column, text: Column) -> Column:
    """Ten hex digits that depend on content alone; a missing page is written ``None``."""
    page_text = F.coalesce(page.cast("string"), F.lit("None"))
    return F.substring(F.sha1(F.concat_ws("|", kind, page_text, text).cast("binary")), 1, 10)


def drop_page_refs(text: Column) -> Column:
    text = F.regexp_replace(text, r"[0-9]+\s*번\s*(?:슬라이드|장)", "")
    return F.regexp_replace(text, r"(?:p\.?\s*|슬라이드\s*)[0-9]+", "")


def name_page_zero(text: Column, label: str = "보강 자료") -> Column:
    """Page 0 is internal; spoken text calls it by the notes label."""
    text = F.regexp_replace(text, r"(?<![0-9])0\s*번(?:\s*(?:슬라이드|장))?", label)
    return F.regexp_replace(text, r"슬라이드\s*(?<![0-9])0(?![0-9])", label)


def parse_message(raw: Column) -> Column:
    """``struct<type, text, deck_id, mode>`` from a JSON object or from plain text."""
    text = F.coalesce(strip(raw), F.lit(""))
    schema = "type string, text string, presentation_id string, mode string, _corrupt_record string"
    obj = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    is_obj = text.startswith("{") & obj["_corrupt_record"].isNull()
    return F.struct(
        F.when(is_obj, F.coalesce(obj["type"], F.lit("stt.final"))).otherwise(F.lit("stt.final")).alias("type"),
        F.when(is_obj, obj["text"]).otherwise(text).alias("text"),
        F.when(is_obj, obj["presentation_id"]).alias("deck_id"),
        F.when(is_obj, obj["mode"]).alias("mode"))
