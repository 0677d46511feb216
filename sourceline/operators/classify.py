"""Rule classifiers as Columns, generated from a profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.profiles import LATIN, Profile
from ..functions.text import content_words, let
from .guards import Words, question_content


def question_type(text: Column, profile: Profile = LATIN) -> Column:
    """Label of the first rule that matches, else the default."""
    out = F.lit(profile.qtype_default)
    for label, pattern in reversed(profile.qtype_rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def expand_by_type(text: Column, profile: Profile = LATIN) -> Column:
    """The question with its type's expansion words behind it. Measured to hurt; kept to compare."""
    kind = question_type(text, profile)
    extra = F.lit("")
    for label, more in profile.query_expansion.items():
        extra = F.when(kind == label, F.lit(more)).otherwise(extra)
    return F.when(extra == "", text).otherwise(F.concat_ws(" ", text, extra))


def core_kind(text: Column, profile: Profile = LATIN) -> Column:
    """Id of the one core kind whose words the question has; a summary kind yields to any
    other; null when none or several match."""
    hits = F.filter(F.array(*[
        F.when(_any_contains(text, kind.words), F.lit(kind.id)) for kind in profile.core_kinds]),
        lambda k: k.isNotNull())
    return let(hits, lambda found: let(
        F.when(F.size(found) > 1, F.array_remove(found, profile.summary_kind)).otherwise(found),
        lambda left: F.when(F.size(left) == 1, F.get(left, F.lit(0)))))


def _any_contains(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def core_kind_of_bare_question(text: Column, profile: Profile = LATIN, words: Words = content_words) -> Column:
    """As :func:`core_kind`, but null as soon as a content word of the deck's own remains."""
    known = [w for kind in profile.core_kinds for w in kind.words]
    rest = F.filter(question_content(text, profile, words),
                    lambda w: ~(_any_contains(w, known) | _contained(w, known)))
    return F.when(F.size(rest) == 0, core_kind(text, profile))


def _contained(word: Column, longer) -> Column:
    out = F.lit(False)
    for text in longer:
        out = out | F.contains(F.lit(text), word)
    return out


def core_label(kind: Column, profile: Profile = LATIN) -> Column:
    out = F.lit(None).cast("string")
    for k in profile.core_kinds:
        out = F.when(kind == k.id, F.lit(k.label)).otherwise(out)
    return out
