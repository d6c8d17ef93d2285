"""Quality classifier: hashed word n-gram logistic regression, fitted with
follow-the-regularised-leader updates and scored as sparse dot products.

A token is a run of bytes that are not white space. Each token gives two words:
its lower-cased bytes, and its shape (case, digits, trailing symbols, length,
whether it repeats the token before). Features are the hashed 1- and 2-grams of
the words and 1- to 3-grams of the shapes; a feature's value is its share of
the document's tokens. Null and empty texts have no feature and get the bias.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textblocks as tb
from .labelled import held_out, training_rows

BITS = 18
U = np.uint64

_UPPER = tb.table_of(lambda b: 65 <= b <= 90).astype(np.int32)
_LOWERCASE = tb.table_of(lambda b: 97 <= b <= 122).astype(np.int32)
_DIGIT = tb.table_of(lambda b: 48 <= b <= 57).astype(np.int32)
_SYMBOL = tb.table_of(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126).astype(np.int32)


def _counts(block, table, starts, ends):
    total = np.concatenate((np.zeros(1, np.int32), np.cumsum(table[block.buf], dtype=np.int32)))
    return total[ends] - total[starts]


def _fold(h: np.ndarray, salt: int) -> np.ndarray:
    return (tb.mix(h + U(salt)) >> U(64 - BITS)).astype(np.int64)


def features(block: tb.Block):
    """(list of (feature ids, first) per family, tokens per document)."""
    starts, ends, h, first = tb.words(block, tb.NOT_SPACE)
    upper, lower, digit, symbol = (_counts(block, t, starts, ends) for t in (_UPPER, _LOWERCASE, _DIGIT, _SYMBOL))
    size = ends - starts
    case = np.where(lower > 0, np.where(upper > 0, 1, 0), np.where(upper > 1, 3, np.where(upper > 0, 2, 4)))
    length = np.searchsorted(np.array([2, 4, 8, 16, 32]), size, side="right")
    same = np.zeros(len(h), np.int64)
    if len(h):
        same[1:] = h[1:] == h[:-1]
    doc = tb.segment_ids(first)
    inner = np.zeros(len(h), bool)  # has a token before it in its document
    if len(h):
        inner[1:] = doc[1:] == doc[:-1]
    same *= inner
    shape = (((case * 2 + (digit > 0)) * 4 + np.minimum(symbol, 3)) * 8 + length) * 2 + same
    s = tb.mix(shape.astype(U) + U(0x5157))
    out = [(_fold(h, 1), first), (_fold(s, 3), first)]
    for gram, salt, seed in ((h, 2, 31), (s, 4, 37)):
        pair = gram[1:] * U(seed) + tb.mix(gram[:-1])
        keep = np.flatnonzero(inner[1:])
        out.append((_fold(pair[keep], salt), np.searchsorted(keep + 1, first)))
    three = np.flatnonzero(inner[2:] & inner[1:-1])
    triple = s[2:] * U(41) + tb.mix(s[1:-1]) * U(43) + tb.mix(s[:-2] + U(7))
    out.append((_fold(triple[three], 5), np.searchsorted(three + 2, first)))
    return out, np.diff(first)


def _sparse(batches):
    """One row a document: the ids of its features and their values."""
    for batch in batches:
        for block in tb.blocks(batch.column("text")):
            families, n = features(block)
            ids, vals = [], []
            for d in range(len(block)):
                f = np.concatenate([x[first[d] : first[d + 1]] for x, first in families])
                at, count = np.unique(f, return_counts=True)
                ids.append(at.astype(np.int32).tobytes())
                vals.append((count / max(1, n[d])).astype(np.float32).tobytes())
            label = batch.column("label").slice(block.rows.start, len(block))
            yield pa.RecordBatch.from_arrays([label, pa.array(ids, pa.binary()), pa.array(vals, pa.binary())], ["label", "ids", "vals"])


def fit_ftrl(rows, epochs=4, alpha=0.6, beta=1.0, l1=0.02, l2=0.02):
    """Weights and bias by FTRL-proximal updates. rows: (label, ids, values)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(7)

    def weight(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, ids, vals = rows[i]
            at = np.append(ids, 1 << BITS)
            x = np.append(vals * SCALE, 1.0)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    return w[:-1].astype(np.float32), float(w[-1])


SCALE = 8.0


class QualityModel:
    """weights: 2**BITS float32, 1 MB whatever the corpus."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score_block(self, block: tb.Block) -> np.ndarray:
        families, n = features(block)
        total = np.zeros(len(block))
        for ids, first in families:
            total += tb.segment_sums(self.weights[ids].astype(np.float64), first)
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * total / np.maximum(1, n), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 5000) -> QualityModel:
    """Learns from at most `most` labelled rows, never from held-out ones.

    Without a labelled row the model scores every text 0.5.
    """
    tb.ship(docs.sparkSession)
    table = training_rows(docs, labels, label, most).select("text", "label").mapInArrow(_sparse, "label int, ids binary, vals binary")
    rows = [(r.label, np.frombuffer(r.ids, np.int32), np.frombuffer(r.vals, np.float32)) for r in table.collect()]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return QualityModel(*fit_ftrl(rows))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """docs with score (double) and predicted (int, score >= threshold) added.

    Columns of those names in docs are replaced; other columns stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        got = [held.value.score_block(b) for b in tb.blocks(batch.column("text"))]
        s = np.concatenate(got) if got else np.zeros(0)
        return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

    return tb.append_columns(docs, {"score": T.DoubleType(), "predicted": T.IntegerType()}, make)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
