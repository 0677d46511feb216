"""Vector Columns over ``array<float>`` / ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    v = as_double(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    from .text import let
    return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))
