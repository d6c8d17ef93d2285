"""Benchmark decontamination: an FM-index per shard of training documents.

Words are runs of 0-9, a-z and all code points from U+0080; A-Z count as a-z.
Every benchmark item gives its windows of `width` words (a shorter item: all its
words as one window). A shard's FM-index holds the maximal runs of words that
occur in the benchmark at all and are long enough for some window, since no
other part of a document can match. Windows are found by backward search,
their places by walking to sampled positions, and the places of a document
are merged to removal spans.

Items are taken in blocks of about `block_bytes` of text, one pass each over
the documents without a shuffle, so that what is broadcast stays bounded.
Null and empty texts have no words. Rows with the same doc_id are separate
documents; items with a null id count under the empty id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .fmindex import FMIndex

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "hit_words": _SPANS, "spans": _SPANS}
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """The distinct windows of a block of items, as rows of word ids."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        rows: dict[tuple, set[str]] = {}
        for item, text in items:
            block = next(tb.blocks(pa.array([text])))
            _, _, h, _ = tb.words(block, tb.WORD)
            for at in range(max(1, len(h) - width + 1)) if len(h) else ():
                rows.setdefault(tuple(h[at : at + width].tolist()), set()).add(item)
        self.vocabulary = np.unique(np.array([x for r in rows for x in r], np.uint64))
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.phrases = np.full((len(rows), width), -1, np.int64)
        for i, r in enumerate(rows):
            self.phrases[i, : len(r)] = np.searchsorted(self.vocabulary, np.array(r, np.uint64)) + 1
        self.items = [sorted(x) for x in rows.values()]

    def runs(self, hashes: np.ndarray, first: np.ndarray):
        """(ids, starts, ends): word ids and the runs that some window may lie in."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        gap = np.zeros(len(known) + 1, bool)
        gap[first] = True
        joined = known[1:] & known[:-1] & ~gap[1:-1]
        starts = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        ends = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        keep = ends - starts >= self.lengths.min()
        return at + 1, starts[keep], ends[keep]


def _scan_batch(texts: pa.Array, phrases: Phrases, before):
    """n_words, n_hit, items, hit_words, spans for each document of a shard."""
    shard, counts, where, base, doc = [], [], [], 0, 0
    places = []
    for block in tb.blocks(texts):
        starts, ends, h, first = tb.words(block, tb.WORD)
        counts.append(np.diff(first))
        if len(h) and len(phrases.vocabulary):
            ids, a, b = phrases.runs(h, first)
            if len(a):
                size = b - a
                seq = np.zeros(int(size.sum()) + len(a), np.int64)
                at = tb.ranges(np.cumsum(size + 1) - size - 1, size)
                seq[at] = ids[tb.ranges(a, size)]
                word = np.full(len(seq), -1, np.int64)
                word[at] = tb.ranges(a, size)
                shard.append(seq)
                where.append(np.where(word >= 0, word + base, -1))
        places.append((block, starts, ends, base, doc))
        base += len(h)
        doc += len(block)
    n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    begin = np.concatenate(([0], np.cumsum(n_words)))
    found: dict[int, tuple[list, set]] = {}
    if shard:
        seq, word = np.concatenate(shard), np.concatenate(where)
        index = FMIndex(seq, len(phrases.vocabulary) + 1)
        low, high = index.search(phrases.phrases, phrases.lengths)
        count = high - low
        which = np.repeat(np.arange(len(low)), count)
        at = word[index.locate(tb.ranges(low, count))]
        docs = np.searchsorted(begin, at, side="right") - 1
        order = np.lexsort((at, docs))
        cuts = np.flatnonzero(np.diff(docs[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            d = int(docs[part[0]])
            a = at[part] - begin[d]
            reach = np.maximum.accumulate(a + phrases.lengths[which[part]])
            new = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
            merged = list(zip(a[new].tolist(), reach[np.concatenate((new[1:] - 1, [len(a) - 1]))].tolist()))
            found[d] = merged, {x for w in np.unique(which[part]) for x in phrases.items[w]}
    for d, (old, items) in before.items():
        merged: list = []
        for s, e in sorted([*old, *found.get(d, ((), ()))[0]]):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        found[d] = merged, set(items) | found.get(d, ((), set()))[1]
    spans: dict[int, list] = {}
    for block, starts, ends, base, doc in places:
        for d in range(doc, doc + len(block)):
            if d in found:
                at = block.off[d - doc]
                chars = np.concatenate(([0], np.cumsum((block.buf[at : block.off[d - doc + 1]] & 0xC0) != 0x80)))
                spans[d] = [(int(chars[starts[begin[d] + s - base] - at]), int(chars[ends[begin[d] + e - 1 - base] - at])) for s, e in found[d][0]]
    n = len(n_words)
    pairs = lambda x: [{"start": s, "end": e} for s, e in x]
    return [
        pa.array(n_words, pa.int64()),
        pa.array([sum(e - s for s, e in found[d][0]) if d in found else 0 for d in range(n)], pa.int64()),
        pa.array([sorted(found[d][1]) if d in found else [] for d in range(n)], pa.list_(pa.string())),
        pa.array([pairs(found[d][0]) if d in found else [] for d in range(n)], _ARROW_SPANS),
        pa.array([pairs(spans[d]) if d in found else [] for d in range(n)], _ARROW_SPANS),
    ]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_words, n_hit, items, hit_words (word indices) and spans (code points) added.

    Columns of docs with these names are replaced. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    out = docs
    for part in range(parts):
        chosen = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast(Phrases([tuple(r) for r in chosen.collect()], width))

        def make(batch, held=held, again=part > 0):
            before = {}
            if again:
                for d, (spans, items) in enumerate(zip(batch.column("hit_words").to_pylist(), batch.column("items").to_pylist())):
                    if spans:
                        before[d] = [(x["start"], x["end"]) for x in spans], items
            return _scan_batch(batch.column("text"), held.value, before)

        out = _append(out, make, carry=part > 0)
    return out


def _append(df, make, carry):
    if not carry:
        return tb.append_columns(df, FIELDS, make)
    inner = [c for c in df.columns if c not in FIELDS]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in inner], *make(batch)], [*inner, *FIELDS])

    return df.mapInArrow(run, T.StructType([*df.select(*inner).schema.fields, *[T.StructField(k, v) for k, v in FIELDS.items()]]))


def remove_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs with the removal spans cut out of text (each leaves one space).

    A document left without any word is dropped; one without a hit is kept as it is.
    """
    columns = docs.columns
    found = scan(tb.set_aside(docs, FIELDS), benchmark, width)
    cuts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.char_length("text").cast("long")))
    kept = F.array_join(F.zip_with(cuts, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), " ")
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(kept)
    out = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))).withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return tb.put_back(out, columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, unnest(CASE WHEN len(w) >= 10 THEN range(1, len(w) - 8) WHEN len(w) > 0 THEN [1] ELSE [] END) AS p FROM b),
win AS (SELECT DISTINCT item, array_to_string(list_slice(w, p, p + 9), ' ') AS g, least(len(w), 10) AS n FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
dp AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes),
dg AS (SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM dp),
hits AS (SELECT dg.r, dg.p, dg.n, win.item FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN its USING (r)
"""
