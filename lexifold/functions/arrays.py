"""Array functions that Spark has no name for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def remove_first(arr, value) -> Column:
    """arr without the first element equal to value."""
    a = col(arr)
    at = F.coalesce(F.array_position(a, value), F.lit(0))
    return F.when(at == 0, a).otherwise(F.concat(F.slice(a, F.lit(1), (at - 1).cast("int")), F.slice(a, (at + 1).cast("int"), F.greatest(F.size(a) - at, F.lit(0)).cast("int"))))


def push(arr, *values) -> Column:
    """arr (null: empty) with the values behind it."""
    more = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
    return F.concat(F.coalesce(col(arr), F.slice(more, 1, 0)), more)


def replace_keyword(arr, old: str, new: str) -> Column:
    """If old is in arr: its first occurrence goes and new comes last; else arr."""
    return F.when(has(arr, old), push(remove_first(arr, F.lit(old)), new)).otherwise(col(arr))


def has(arr, value) -> Column:
    """array_contains that is false, never null, for null arrays and for null elements without a hit."""
    return F.coalesce(F.array_contains(col(arr), value), F.lit(False))


def has_prefix(arr, prefix: str) -> Column:
    return F.coalesce(F.exists(col(arr), lambda x: F.coalesce(F.startswith(x, F.lit(prefix)), F.lit(False))), F.lit(False))


def chars(c) -> Column:
    """The characters, each one element; linear in the length."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), ""), lambda x: x != "")


def page_range(c) -> Column:
    """"1-3,5" as zero-based page numbers; parts that are no ranges are left out."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.trim(x))

    def pages(p):
        a, b = F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.regexp_extract(p, r"(\d+)$", 1).cast("int")
        ok = p.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$")
        return F.when(ok & (a >= 1) & (b >= a), F.sequence(a - 1, b - 1)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, pages))
