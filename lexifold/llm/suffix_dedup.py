"""Suffix-array dedup: removes bytes covered by a string of `length` bytes that starts earlier.

Texts are UTF-8 bytes (null: empty); strings never cross documents. Earlier is
a smaller doc_id, or the same document and an earlier start. Rows that share a
doc_id count as separate documents in the order of their texts; rows without a
doc_id come before all others.

Every string of `length` bytes has an anchor, the leftmost least hash among its
grams of 20 bytes, so equal strings have equal anchors. Consecutive starts with
one anchor form a run. Runs whose anchor occurs once cannot repeat and go no
further (only hashes and places are shuffled for this). Before anything is
sorted, equal rows are brought together: of equal whole documents, and of equal
whole runs, the earliest stands for all. The distinct runs travel, with their
bytes, to the partition of their anchor's hash. There a suffix array of all of
them is built by two-stage sorting (suffix_array.py), neighbours that share
`length` bytes are joined to classes, and all of a class but its earliest are
repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .ngram_join import _groups, _whole_groups
from .suffix_array import common_prefix_at_least, suffix_array

U = np.uint64
GRAM = 20
BLOCK = 2 << 20
FIRST = -(2**63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for every i that leaves room."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchored_runs(block: tb.Block, length: int):
    """(doc, start, count, key) of the runs: window starts within their documents."""
    n = len(block.buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U)
    sums = tb.prefix_sums(block.buf, tb.PLAIN)
    gram = tb.mix((sums[GRAM:] - sums[:-GRAM]) * tb._power(tb.BASE_INV, n + 1)[: n + 1 - GRAM])
    bits = U(max(1, n.bit_length()))
    ranked = ((gram >> bits) << bits) | np.arange(len(gram), dtype=U)
    least = _sliding_min(ranked, length - GRAM + 1)
    anchor = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    sizes = np.maximum(np.diff(block.off) - 1 - length + 1, 0)
    at = tb.ranges(block.off[:-1], sizes)
    doc = np.repeat(np.arange(len(block)), sizes)
    if not len(at):
        return none, none, none, none.astype(U)
    own = anchor[at]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.concatenate((new, [len(at)])))
    return doc[new], at[new] - block.off[doc[new]], count, gram[own[new]]


class _Order:
    """Numbers the rows of one doc_id, which must come sorted by (d, text)."""

    def __init__(self):
        self.d, self.sub = None, 0

    def number(self, ids) -> np.ndarray:
        out = np.zeros(len(ids), np.int32)
        if len(ids):
            if len(np.unique(ids)) == len(ids) and ids[0] != self.d:
                self.d, self.sub = ids[-1], 0
                return out
            for i, d in enumerate(ids):
                self.sub = self.sub + 1 if d == self.d else 0
                self.d = d
                out[i] = self.sub
        return out


def _merge(start: np.ndarray, end: np.ndarray):
    """Maximal runs of the union of intervals."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]


def _originals(batch):
    return pc.if_else(batch.column("copy"), "", batch.column("text"))


def _find_runs(length):
    """Every run as a row; of equal ones in a block just the first, the others as repeated intervals."""

    def run(batches):
        order = _Order()
        for batch in batches:
            d = batch.column("d").to_numpy()
            sub = order.number(d)
            for block in tb.blocks(_originals(batch)):
                doc, start, count, key = anchored_runs(block, length)
                if not len(doc):
                    continue
                a = block.off[doc] + start
                whole = tb.span_hash(tb.prefix_sums(block.buf, tb.PLAIN), a, a + count + length - 1)
                first = np.zeros(len(key), bool)
                first[np.unique(whole, return_index=True)[1]] = True
                row = block.rows.start + doc
                yield _row_batch(key[first], whole[first], d[row[first]], sub[row[first]], start[first], count[first])
                if not first.all():
                    base = (row[~first] - block.rows.start) * (1 << 40) + start[~first]
                    s, e = _merge(base, base + count[~first] + length - 1)
                    row, s, e = block.rows.start + (s >> 40), s & ((1 << 40) - 1), e & ((1 << 40) - 1)
                    yield _row_batch(tb.mix(d[row].astype(U) + s.astype(U)), np.zeros(len(s), U), d[row], sub[row], s, s - e)

    return run, "route long, whole long, d long, sub int, start int, count int"


def _row_batch(route, whole, d, sub, start, count):
    """count: starts in the run; negative: a repeated interval of that many bytes."""
    cols = [route.view(np.int64), whole.view(np.int64), d, sub, start.astype(np.int32), count.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["route", "whole", "d", "sub", "start", "count"])


def _repeated(length):
    """Runs whose route, the anchor's hash, has another row; of equal ones but the first as repeated intervals.

    Sorted by (route, whole, d, sub, start).
    """

    def run(batches):
        for t in _whole_groups(batches, "route"):
            route, whole, count = (t.column(c).to_numpy() for c in ("route", "whole", "count"))
            count = count.copy()
            a, b = _groups(route)
            keep = count < 0
            keep[tb.ranges(a, b - a)] = True
            equal = np.concatenate(([False], (route[1:] == route[:-1]) & (whole[1:] == whole[:-1]))) & (count > 0)
            count[equal] = -(count[equal] + length - 1)
            out = t.select(["d", "sub", "start"]).append_column("count", pa.array(count)).filter(pa.array(keep))
            yield from out.to_batches()

    return run, "d long, sub int, start int, count int"


def _collect_runs(length):
    """The bytes of each run with its anchor's hash; repeated intervals without bytes."""

    def run(batches):
        order = _Order()
        for batch in batches:
            d = batch.column("d").to_numpy()
            sub = order.number(d)
            runs = batch.column("runs")
            flat, offs = runs.values, runs.offsets.to_numpy()
            r_sub, r_start, r_count = (flat.field(c).to_numpy() for c in ("sub", "start", "count"))
            for block in tb.blocks(_originals(batch)):
                rows = np.arange(block.rows.start, block.rows.start + len(block))
                n = offs[rows + 1] - offs[rows]
                at, doc = tb.ranges(offs[rows], n), np.repeat(np.arange(len(block)), n)
                mine = r_sub[at] == sub[rows[doc]]
                at, doc = at[mine], doc[mine]
                start, count = r_start[at].astype(np.int64), r_count[at].astype(np.int64)
                old = count < 0
                if old.any():
                    base = doc[old] * (1 << 40) + start[old]
                    s, e = _merge(base, base - count[old])
                    row, s, e = block.rows.start + (s >> 40), s & ((1 << 40) - 1), e & ((1 << 40) - 1)
                    yield _run_batch(tb.mix(d[row].astype(U) + s.astype(U)).view(np.int64), d[row], sub[row], s, e - s, pa.nulls(len(row), pa.binary()))
                doc, start, count = doc[~old], start[~old], count[~old]
                if len(doc):
                    a, size = block.off[doc] + start, count + length - 1
                    data = pa.Array.from_buffers(
                        pa.binary(), len(a), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(block.buf[tb.ranges(a, size)])]
                    )
                    key = _anchor_keys(tb.prefix_sums(block.buf, tb.PLAIN), block, a, count, length)
                    yield _run_batch(key.view(np.int64), d[rows[doc]], sub[rows[doc]], start, count, data)

    return run, "key long, d long, sub int, start int, count int, bytes binary"


def _anchor_keys(sums, block, a, count, length):
    """The hash of the least gram that all windows of each run share: the one that anchors them."""
    # windows a .. a+count-1 share the grams from a+count-1 to a+length-GRAM
    lo, n = a + count - 1, length - GRAM + 2 - count
    at = tb.ranges(lo, n)
    gram = tb.mix((sums[at + GRAM] - sums[at]) * tb._power(tb.BASE_INV, len(sums))[at])
    bits = U(max(1, len(block.buf).bit_length()))
    ranked = ((gram >> bits) << bits) | at.astype(U)
    cuts = np.cumsum(n) - n
    least = (np.minimum.reduceat(ranked, cuts) & ((U(1) << bits) - U(1))).astype(np.int64)
    return tb.mix((sums[least + GRAM] - sums[least]) * tb._power(tb.BASE_INV, len(sums))[least])


def _run_batch(key, d, sub, start, count, data):
    cols = [pa.array(key), pa.array(d), pa.array(sub, pa.int32()), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), data]
    return pa.RecordBatch.from_arrays(cols, ["key", "d", "sub", "start", "count", "bytes"])


def _repeats_in(t: pa.Table, length: int):
    """(row, first offset, last offset) of the repeated starts. t: sorted by key, then earliest first."""
    raw, off = tb.flat_bytes(t.column("bytes"))
    size = np.diff(off)
    count = t.column("count").to_numpy().astype(np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(size), np.uint8)
    text[tb.ranges(begin, size)] = np.where(raw == 0, np.uint8(255), raw)  # 255 is in no UTF-8 text
    order = suffix_array(text, length)
    valid = np.zeros(len(text), bool)
    valid[tb.ranges(begin, count)] = True
    order = order[valid[order]]
    same = common_prefix_at_least(text, order, length)
    cuts = np.flatnonzero(np.concatenate(([True], ~same)))
    earliest = np.minimum.reduceat(order, cuts)
    repeated = valid
    repeated[earliest] = False
    starts, ends = tb.spans(repeated)
    row = np.searchsorted(begin, starts, side="right") - 1
    return row, starts - begin[row], ends - 1 - begin[row]


def _sort_runs(length):
    def whole(batches):
        held, size = [], 0
        for t in _whole_groups(batches, "key"):
            held.append(t)
            size += t.column("bytes").nbytes
            if size >= BLOCK:
                yield pa.concat_tables(held)
                held, size = [], 0
        if held:
            yield pa.concat_tables(held)

    def run(batches):
        names = ["d", "sub", "start", "end"]
        for t in whole(batches):
            known = t.filter(t.column("bytes").is_null())
            if known.num_rows:
                start, n = (known.column(c).to_numpy().astype(np.int64) for c in ("start", "count"))
                yield pa.RecordBatch.from_arrays([known.column("d").combine_chunks(), known.column("sub").combine_chunks(), pa.array(start), pa.array(start + n)], names)
            t = t.filter(t.column("bytes").is_valid())
            if t.num_rows:
                row, a, b = _repeats_in(t, length)
                d, sub, start = (t.column(c).to_numpy() for c in ("d", "sub", "start"))
                start = start[row].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array(sub[row], pa.int32()), pa.array(start + a), pa.array(start + b + length)], names)

    return run, "d long, sub int, start long, end long"


def _apply(length):
    """Merges each document's repeated intervals and cuts them out."""

    def run(batches):
        order = _Order()
        for batch in batches:
            d = batch.column("d").to_numpy()
            sub = order.number(d)
            kept, spans, n_bytes = [], [], []
            for i, (text, copy, found) in enumerate(zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), batch.column("found"))):
                raw = text.encode()
                mine = [(0, len(raw))] if copy and len(raw) >= length else []
                if found.is_valid and len(found.values):
                    own = found.values.field("sub").to_numpy() == sub[i]
                    if own.any():
                        s, e = _merge(found.values.field("start").to_numpy()[own], found.values.field("end").to_numpy()[own])
                        mine = list(zip(s.tolist(), e.tolist()))
                at, left = 0, []
                for s, e in mine:
                    left.append(raw[at:s])
                    at = e
                left.append(raw[at:])
                kept.append(b"".join(left))
                spans.append([{"start": s, "end": e} for s, e in mine])
                n_bytes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["d", "n_bytes", "spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte spans and the bytes left, for every row of docs.

    kept is binary, as a cut may fall inside a character.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    tb.ship(docs.sparkSession)
    keyed = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = keyed.repartition("d")
    in_order = lambda df: df.sortWithinPartitions("d", "text")
    # whole documents that are copies of an earlier one
    sums = keyed.select("d", F.md5(F.col("text").cast("binary")).alias("sum"))
    least = sums.groupBy("sum").agg(F.min("d").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = sums.join(least, "sum").where("d > least").groupBy("d").agg(F.collect_set("sum").alias("copied"))
    marked = dealt.join(copies, "d", "left").withColumn("copy", F.coalesce(F.array_contains("copied", F.md5(F.col("text").cast("binary"))), F.lit(False)))
    marked = marked.select("d", "text", "copy")
    runs = in_order(marked).mapInArrow(*_find_runs(length))
    again = runs.repartition("route").sortWithinPartitions("route", "whole", "d", "sub", "start").mapInArrow(*_repeated(length))
    by_doc = again.groupBy("d").agg(F.collect_list(F.struct("sub", "start", "count")).alias("runs"))
    moved = in_order(marked.join(by_doc, "d")).select("d", "text", "copy", "runs").mapInArrow(*_collect_runs(length))
    found = moved.repartition("key").sortWithinPartitions("key", "d", "sub", "start").mapInArrow(*_sort_runs(length))
    removed = found.groupBy("d").agg(F.collect_list(F.struct("sub", "start", "end")).alias("found"))
    joined = in_order(marked.join(removed, "d", "left")).select("d", "text", "copy", "found")
    out = joined.mapInArrow(_apply(length), "d long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select(F.when(F.col("d") != FIRST, F.col("d")).alias("doc_id"), "n_bytes", "spans", "kept")


def report(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = remove_repeats(docs, length)
    kept = F.octet_length("kept").cast("long")
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def brute_force(rows: list[tuple[int, str | None]], length: int = 100) -> list[tuple]:
    """The same by a dictionary of all strings, for small tests."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            s = raw[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\x01" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out
