"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null if a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a) -> Column:
    n = norm(a)
    return F.transform(col(a), lambda x: F.try_divide(x, n))
