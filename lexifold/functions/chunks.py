"""Overlapping character windows for embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def chunk_starts(n, length: int, overlap: int) -> Column:
    """Zero-based starts of the windows over n characters: every length - overlap, and one flush with the end.

    None for no characters. A text between one step and one length long gives
    its only window twice, once for the step and once for the end.
    """
    if length <= 0 or overlap < 0 or overlap >= length:
        return F.array().cast("array<int>")
    n = col(n)
    step = length - overlap
    last = F.greatest(F.lit(0), F.floor((n - length) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: k * step)
    tail = F.when((last + 1) * step < n, F.array(F.greatest(F.lit(0), n - length).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(n > 0, F.concat(starts, tail)).otherwise(F.array().cast("array<int>"))


def chunks(content, length: int = 200, overlap: int = 50) -> Column:
    """array<struct<chunk_id, chunk>>, chunk_id from 1."""
    t = F.trim(F.coalesce(col(content), F.lit("")))
    starts = chunk_starts(F.char_length(t), length, overlap)
    return F.transform(starts, lambda s, i: F.struct((i + 1).alias("chunk_id"), F.substring(t, s + 1, F.lit(length)).alias("chunk")))
