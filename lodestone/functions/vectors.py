"""Vector expressions over arrays of numbers, in double precision (MA*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """MA1: divided by its length, which is worked out once; a zero vector stays."""
    by = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(norm(a)), by), F.lit(0))


def rounded(x: Column, places: int) -> Column:
    """Rounded with its sign: what is negative and rounds to nothing is -0.0."""
    return F.round(F.abs(x), places) * F.signum(x)


def cosine(a: Column, b: Column) -> Column:
    """MA2: cosine similarity, rounded to 6 places so that ties are ties on any machine; null for a zero vector."""
    return F.round(F.try_divide(dot(a, b), norm(a) * norm(b)), 6)
