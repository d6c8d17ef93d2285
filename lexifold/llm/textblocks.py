"""Vectorised kernels over UTF-8 text held in Arrow buffers.

Python workers see record batches; every kernel works on the raw bytes of a
block of whole documents (about 1 MB at a time, a longer document alone), so
memory is bounded by the longest document and no Python code runs per word.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def ship(spark) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads all 64 bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    had = _powers.get(base)
    if had is None or len(had) < n:
        size = max(n, (1 << 20) + (1 << 18))
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        had = _powers[base] = np.cumprod(steps, dtype=U64)
    return had[:n]


def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with lower, A-Z share those of a-z."""
    table = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
    if lower:
        table[65:91] = table[97:123]
    return table


LOWER = byte_values(True)
PLAIN = byte_values(False)


class Block:
    """Whole documents as one byte array; a newline stands after each of them."""

    __slots__ = ("buf", "off", "rows")

    def __init__(self, texts: pa.Array, rows: slice):
        joined = pc.binary_join_element_wise(texts, "", "\n")
        if pa.types.is_large_string(joined.type):
            offsets = np.frombuffer(joined.buffers()[1], np.int64)
        else:
            offsets = np.frombuffer(joined.buffers()[1], np.int32)
        off = offsets[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
        data = joined.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.rows = rows

    def __len__(self) -> int:
        return len(self.off) - 1


def blocks(texts: pa.Array, max_bytes: int = 1 << 20, max_rows: int = 1000):
    """Cuts a column of texts (null: empty) into blocks of whole documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + max_bytes, side="right"))
        to = min(max(to, at + 1), at + max_rows)
        yield Block(texts.slice(at, to - at), slice(at, to))
        at = to


def prefix_sums(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of table[buf[j]] * BASE**j for s <= j < e, modulo 2**64."""
    out = np.empty(len(buf) + 1, U64)
    out[0] = 0
    np.cumsum(table[buf] * _power(BASE, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, the same wherever a span stands."""
    return mix((sums[ends] - sums[starts]) * _power(BASE_INV, len(sums))[starts] + (ends - starts).astype(U64))


def spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true; the last flag must be false."""
    turn = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if len(flag) and flag[0]:
        turn = np.concatenate(([0], turn))
    return turn[0::2], turn[1::2]


def table_of(accept) -> np.ndarray:
    return np.array([bool(accept(b)) for b in range(256)])


SPACE = table_of(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
NOT_SPACE = ~SPACE
WORD = table_of(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
LETTER = table_of(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def words(block: Block, kind: np.ndarray, table: np.ndarray = LOWER):
    """(starts, ends, hashes, first): the runs of bytes of a kind; first[i] is document i's first word."""
    starts, ends = spans(kind[block.buf])
    hashes = span_hash(prefix_sums(block.buf, table), starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, block.off)


def word_hash(word: str, table: np.ndarray = LOWER) -> int:
    """The hash that words() gives to this word."""
    buf = np.frombuffer(word.encode() + b"\n", np.uint8)
    return int(span_hash(prefix_sums(buf, table), np.array([0]), np.array([len(buf) - 1]))[0])


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; an empty segment has 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def segment_ids(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on, as one array."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(begin - starts, lengths)


def set_aside(df, names):
    """df with columns of these names called otherwise, so that an operator can use the names; see put_back."""
    for c in df.columns:
        if c in names:
            df = df.withColumnRenamed(c, f"__own_{c}")
    return df


def put_back(df, columns):
    """The given columns of df, those set aside under their own names again."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`__own_{c}`").alias(c) if f"__own_{c}" in df.columns else F.col(f"`{c}`") for c in columns])


def append_columns(df, fields: dict, make):
    """df with columns added by make(record batch) -> arrays, one for each of fields.

    fields: name -> Spark type. A column of df that has one of these names is
    replaced; all others, whatever they are called, pass through.
    """
    from pyspark.sql import types as T

    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in fields]
    kept = df.select(*[f"`{c}`" for c in keep]) if keep != df.columns else df
    schema = T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in fields.items()]])
    names = schema.names

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names)

    return kept.mapInArrow(run, schema)


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a binary column, where each value begins and the last ends), however many chunks and bytes it has."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), off - off[0]


def append_by_block(df, fields: dict, make, text: str = "text"):
    """As append_columns, but make(block, record batch of the block's rows) -> arrays.

    Each block of whole texts leaves as a record batch of its own, so no array
    grows beyond the longest document.
    """
    from pyspark.sql import types as T

    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in fields]
    at = keep.index(text) if text in keep else None
    source = df.select(*[f"`{c}`" for c in [*keep, *([] if at is not None else [text])]])
    at = len(keep) if at is None else at
    schema = T.StructType([*[f for f in source.schema.fields[: len(keep)]], *[T.StructField(k, v) for k, v in fields.items()]])
    names = schema.names

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(at)):
                part = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *make(block, part)], names)

    return source.mapInArrow(run, schema)


def joined_words(block: Block, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each document its words (spans of the block; document i has those from first[i] on) joined by single spaces."""
    size = ends - starts + 1  # with what stands after the word: the block ends each document by a line feed
    out = block.buf[ranges(starts, size)]
    stop = np.concatenate(([0], np.cumsum(size)))
    out[stop[1:] - 1] = 0x20
    last = stop[first[1:]][np.diff(first) > 0] - 1
    out = np.delete(out, last)
    offsets = stop[first] - np.concatenate(([0], np.cumsum(np.diff(first) > 0)))
    wide = len(out) >= 1 << 31
    made = (pa.LargeStringArray if wide else pa.StringArray).from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32).tobytes()), pa.py_buffer(out.tobytes()))
    return made
