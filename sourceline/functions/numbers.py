"""Are the numbers in a text backed by its source?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import find_all, let, squeeze

# ---- fixed values -------------------------------------------------------------------
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
NAME_WITH_DIGIT = r"[A-Za-z]+[-_]?[0-9]+(?:\.[0-9]+)*[A-Za-z]*(?:-[A-Za-z][A-Za-z0-9]*)*"
NUMBER_NOT_IN_NAME = r"(?<![A-Za-z])[0-9]+(?:[.,][0-9]+)*"
# -------------------------------------------------------------------------------------


def numbers(text: Column) -> Column:
    return find_all(text, NUMBER)


def _in_source(squeezed: Column):
    return lambda n: squeezed.contains(F.replace(n, F.lit(","), F.lit("")))


def numbers_supported(text: Column, source: Column) -> Column:
    """Every number of the text occurs in the source, blanks and commas aside."""
    return let(squeeze(source), lambda tight: F.forall(numbers(text), _in_source(tight)))


def _name_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def without_known_names(text: Column, source: Column, question: Column) -> Column:
    """Blank out names with digits in them (a model name, say) that source or question use.

    Text is cut into alternating plain and name pieces, so each name is judged where it stands.
    """
    return let(_known_names(source, question), lambda names: _without(text, names))


def _known_names(source: Column, question: Column) -> Column:
    return F.concat(_name_key(source), F.lit("|"), _name_key(question))


def _without(text: Column, names: Column) -> Column:
    pieces = find_all(text, rf"{NAME_WITH_DIGIT}|[A-Za-z]+|[^A-Za-z]+")
    return F.array_join(F.transform(pieces, lambda piece: F.when(
        piece.rlike(f"^{NAME_WITH_DIGIT}$") & names.contains(_name_key(piece)), F.lit(" ")).otherwise(piece)), "")


def known_source(source: Column, question: Column) -> Column:
    """``struct<tight, names>``: what :func:`supported_by` looks into."""
    return F.struct(squeeze(source).alias("tight"), _known_names(source, question).alias("names"))


def supported_by(text: Column, known: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.forall(numbers(_without(text, known["names"])), _in_source(known["tight"]))).otherwise(True)


def all_supported_by_name(texts: Column, source: Column, question: Column) -> Column:
    """For each of ``texts`` whether its numbers are supported; source and question are prepared once.

    Digits inside a known name pass. A question vouches for names only, never for bare numbers.
    """
    return let(known_source(source, question), lambda known: F.transform(texts, lambda text: supported_by(text, known)))


def numbers_supported_by_name(text: Column, source: Column, question: Column) -> Column:
    """:func:`all_supported_by_name` of one text."""
    return F.get(all_supported_by_name(F.array(text), source, question), F.lit(0))


def unsupported_numbers(text: Column, source: Column, min_chars: int = 2) -> Column:
    return let(squeeze(source), lambda tight: F.filter(
        numbers(text), lambda n: (F.length(n) >= min_chars) & ~_in_source(tight)(n)))


def new_numbers(text: Column, source: Column) -> Column:
    """Numbers that are not part of a name and that the source does not have, commas off."""
    found = F.transform(find_all(text, NUMBER_NOT_IN_NAME), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return let(squeeze(source), lambda tight: F.filter(found, lambda n: ~tight.contains(n)))
