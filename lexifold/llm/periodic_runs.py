"""Periodic runs of words in texts, and texts with their repetitions collapsed.

Words are the maximal runs of other characters than the ASCII white space. A run
is a stretch of consecutive words in which words a period apart are equal, as
long as it can be; its period is its smallest. They are found by tandem.py, a
document at a time: nothing crosses documents, nothing is shuffled, memory goes
with the longest document.

Null and blank texts have no words and no runs; equal rows have equal results;
columns of the given names are replaced and all others pass through. Words count
as equal if their 64-bit hashes within one document are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tandem
from . import textblocks as tb

RUN = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])


def find(docs: DataFrame, min_length: int = 2, min_exponent: int = 2) -> DataFrame:
    """docs with `runs` (structs of start, length, period in words, by start, then period) and `collapsed`.

    Runs are those of at least max(min_length, min_exponent * period) words.
    collapsed is the text without the words that any run contains after its
    first period, words joined by one space.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods at least")

    def make(block, _):
        starts, ends, hashes, first = tb.words(block, tb.NOT_SPACE, tb.PLAIN)
        doc, start, length, period = tandem.runs(hashes, first, min_length, min_exponent)
        drop = np.zeros(len(starts) + 1, np.int64)
        np.add.at(drop, first[doc] + start + period, 1)
        np.add.at(drop, first[doc] + start + length, -1)
        keep = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
        of_doc = np.searchsorted(doc, np.arange(len(block) + 1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(of_doc), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], RUN.names))
        return found, tb.joined_words(block, starts[keep], ends[keep], np.searchsorted(keep, first))

    return tb.append_by_block(docs, {"runs": T.ArrayType(RUN), "collapsed": T.StringType()}, make)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each tenth document, chosen by its id's hash, words from some place on repeat with a period.

    With h the unsigned crc32 of the id in decimal and g = h div 10, documents
    with h divisible by 10 and n > 0 words: from word a = g mod n on, words are
    those from a on with period 1 + (n - a) div (3 + g mod 8). Documents without
    an id stay as they are.
    """

    def make(block, part):
        texts, hashes = part.column("text"), part.column("h").to_pylist()
        chosen = [i for i, h in enumerate(hashes) if h is not None and h % 10 == 0 and texts[i].is_valid]
        if not chosen:
            return [texts]
        new = texts.to_pylist()
        for i in chosen:
            words = texts[i].as_py().encode().split()  # at the same six characters
            if words:
                n, g = len(words), hashes[i] // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                new[i] = b" ".join(words[:a] + [words[a + j % p] for j in range(n - a)]).decode()
        made = pa.array(new, pa.string())
        return [made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made]

    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return tb.append_by_block(rows.withColumnRenamed("text", "given"), {"text": T.StringType()}, lambda block, part: make(block, part.rename_columns(["doc_id", "text", "h"])), text="given").select("doc_id", "text")


def report(docs: DataFrame) -> DataFrame:
    """A row a document: number of runs of at least max(6, 4 periods) words, the one of greatest exponent, digests.

    Documents are those of with_repeated_tails. Of equal exponents the smallest
    start counts, then the smallest period; without a run those columns are null.
    """
    found = find(with_repeated_tails(docs), 6, 4)
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        *[F.col(f"best.{k}").alias(k) for k in RUN.names],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
