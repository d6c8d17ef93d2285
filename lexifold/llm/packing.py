"""Best-fit packing with several permitted sequence lengths.

A document counts as its ids and one for its end; one longer than the greatest
length is cut into pieces of that length and a rest, so every id is packed once.
Pieces travel with their ids and are dealt by hash into shards of about
`shard_bytes` of text. In a shard, the longest first, each piece goes to the open bin with the least room that holds
it. If none does, the bin size is opened whose cost, less the value of the room
it leaves, is least: room is worth the cheapest cost per id, as far as the
pieces still to come can fill all open room. At last every bin is made as small
as its contents allow.

A bin comes out as one row: its ids, filled up to its length with `pad`, and the
parts, in the order of their places, that say which document's ids lie where.
Attention masks follow from the parts; the loss mask is the first n_ids places.

Null and empty texts have the end alone. Rows may repeat and ids may be null or
repeat; each row is packed, its parts naming the id it has. Columns other than
doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .ngram_join import _whole_groups
from .tokens import WordEncoder, default_path, read_tokenizer

LENGTHS = (512, 1024, 2048, 4096, 8192)
BIN_COST = 48  # of any bin, in ids


def best_fit(sizes, lengths=LENGTHS, bin_cost=BIN_COST):
    """(bin of each piece, offset in it, final length of each bin). sizes: at most lengths[-1] each."""
    lengths = sorted(lengths)
    cost = {c: c + bin_cost for c in lengths}
    worth = min(cost[c] / c for c in lengths)
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # bins by what they still hold
    mask = 0  # bit r is set if some bin has room r
    used: list[int] = []
    where = np.zeros(len(sizes), np.int64)
    offset = np.zeros(len(sizes), np.int64)
    order = np.argsort(-np.asarray(sizes), kind="stable").tolist()
    left, open_room = int(np.sum(sizes)), 0
    for i in order:
        s = int(sizes[i])
        left -= s
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            open_room -= s
        else:
            r = min((c for c in lengths if c >= s), key=lambda c: (cost[c] - worth * (c - s) * min(1.0, left / (open_room + c - s + 1)), c))
            b = len(used)
            used.append(0)
            open_room += r - s
        where[i], offset[i] = b, used[b]
        used[b] += s
        room[r - s].append(b)
        mask |= 1 << (r - s)
    final = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return where, offset, final


def _pieces(docs: DataFrame, longest: int, end: int, tokenizer: str | None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, ids) of every piece; ids: four bytes each."""
    tb.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer or default_path()))

    def run(batches):
        encoder = WordEncoder.shared(held.value)
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                got, size = encoder.encode(block)
                size = size + 1
                stop = np.cumsum(size)
                ids = np.full(int(stop[-1]), end, "<i4")
                body = np.ones(len(ids), bool)
                body[stop - 1] = False
                ids[body] = got
                many = -(-size // longest)
                doc = np.repeat(np.arange(len(block)), many)
                piece = tb.ranges(np.zeros(len(many), np.int64), many)
                length = np.minimum(longest, size[doc] - piece * longest)
                # pieces lie one after the other in ids, as documents do
                data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.concatenate(([0], 4 * np.cumsum(length))).astype(np.int32)), pa.py_buffer(ids)])
                cols = [batch.column("doc_id").slice(block.rows.start, len(block)).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * longest), pa.array(length.astype(np.int32)), data]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, n_tokens int, ids binary")


PARTS = "array<struct<doc_id: long, piece: int, start: long, n_tokens: int, bin_start: int>>"


def _sequences(t: pa.Table, lengths, bin_cost: int, pad: int, at_once: int = 1 << 21):
    """Batches of the packed bins of one shard's pieces."""
    size = t.column("n_tokens").to_numpy().astype(np.int64)
    where, offset, final = best_fit(size, lengths, bin_cost)
    order = np.lexsort((offset, where))
    raw, place = tb.flat_bytes(t.column("ids"))
    t, size, where, offset = t.drop_columns("ids").take(pa.array(order)), size[order], where[order], offset[order]
    begin = place[:-1][order]
    first = np.searchsorted(where, np.arange(len(final) + 1))
    ends = np.cumsum(final)
    shard = int(t.column("shard")[0].as_py())
    low = 0
    while low < len(final):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + at_once)))
        a, b = int(first[low]), int(first[high])
        base = np.cumsum(final[low:high]) - final[low:high]
        ids = np.full(int(final[low:high].sum()), pad, np.int32)
        mine = np.concatenate([raw[i : i + 4 * n] for i, n in zip(begin[a:b].tolist(), size[a:b].tolist())])
        ids[tb.ranges(base[where[a:b] - low] + offset[a:b], size[a:b])] = mine.view("<i4")
        parts = [t.column(c).slice(a, b - a) for c in ("doc_id", "piece", "start", "n_tokens")]
        parts = [pa.concat_arrays(x.chunks) for x in parts] + [pa.array(offset[a:b].astype(np.int32))]
        parts = pa.StructArray.from_arrays(parts, ["doc_id", "piece", "start", "n_tokens", "bin_start"])
        cols = [
            pa.array(shard * (1 << 24) + np.arange(low, high)), pa.array(final[low:high].astype(np.int32)), pa.array(np.add.reduceat(size[a:b], first[low:high] - a).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.append(base, len(ids)).astype(np.int32)), pa.array(ids)), pa.ListArray.from_arrays(pa.array((first[low : high + 1] - a).astype(np.int32)), parts),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["bin_id", "capacity", "n_ids", "ids", "parts"])
        low = high


def pack(docs: DataFrame, lengths=LENGTHS, bin_cost: int = BIN_COST, shard_bytes: int = 16 << 20, shard_rows: int = 8000, tokenizer: str | None = None, end: int = 2, pad: int = 0) -> DataFrame:
    """(bin_id, capacity, n_ids, ids, parts): the packed sequences.

    parts: doc_id, piece, start (of the piece in its document's ids), n_tokens
    and bin_start (its place among the bin's ids).
    """
    lengths = sorted(lengths)
    total = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(1, -(-(total[0] or 0) // shard_bytes), -(-total[1] // shard_rows))
    pieces = _pieces(docs, lengths[-1], end, tokenizer)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(shards)))

    def run(batches):
        for t in _whole_groups(batches, "shard"):
            shard = t.column("shard").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield from _sequences(t.slice(a, b - a), lengths, bin_cost, pad)

    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "piece", "n_tokens")
    return dealt.mapInArrow(run, f"bin_id long, capacity int, n_ids int, ids array<int>, parts {PARTS}")
