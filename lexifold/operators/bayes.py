"""Multinomial naive Bayes over hashed features of texts: languages by character triples, sentiment by words.

Fitting is one aggregation: tasks count features by label and feature number
over whole texts, and the counts are summed. Texts are taken some at a time, as
one array of code points. Scoring gathers, for all features of
a text, the logarithms of (count + 1) / (all counts of the label + features) and
sums them. A model has one number for each label and feature, so its size is
bounded, and so is its broadcast.

Features are numbered by arithmetic on code points, modulo a power of two:
triples of neighbouring characters (c1, c2, c3) by 961 c1 + 31 c2 + c3; words
(runs of other characters than ASCII ones that are no letter or digit, A-Z
lower-cased) by the polynomial of 31.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .graph import written

MOST_LABELS = 256

_ASCII_WORD = np.array([chr(i).isalnum() for i in range(128)])
_LOWER = np.array([ord(chr(i).lower()) for i in range(128)], np.uint64)


def triples(codes: np.ndarray, bits: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of texts, their number in each); codes: the texts' characters, size of them each."""
    if len(codes) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(size), np.int64)
    c = codes.astype(np.uint32)  # 993 times the last code point is below 2 ** 31
    f = c[:-2] * np.uint32(961)
    f += c[1:-1] * np.uint32(31)
    f += c[2:]
    f &= np.uint32((1 << bits) - 1)
    inside = np.ones(len(f), bool)
    ends = np.cumsum(size)
    for back in (1, 2):  # no triple begins with a text's last two characters
        at = ends - back
        at = at[(size >= back) & (at < len(f))]
        inside[at] = False
    return f[inside], np.maximum(size - 2, 0)


def words(codes: np.ndarray, bits: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As triples."""
    c = codes.astype(np.uint64)
    low = c < 128
    inside = ~low
    inside[low] = _ASCII_WORD[c[low]]
    c[low] = _LOWER[c[low]]
    # a text's first character goes on with no word
    ends = np.cumsum(size)
    first = np.zeros(len(c) + 1, bool)
    first[ends - size] = True
    before = np.concatenate(([False], inside[:-1])) if len(c) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    after = np.concatenate((inside[1:], [False]))
    length = np.flatnonzero(inside & (~after | first[1:])) + 1 - starts
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    left = np.repeat(length, length) - 1 - place
    power = np.cumprod(np.concatenate(([1], np.full(int(length.max()) - 1, 31))).astype(np.uint64), dtype=np.uint64)
    sums = np.add.reduceat(c[inside] * power[left], np.cumsum(length) - length)
    n = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - size)
    return (sums & np.uint64((1 << bits) - 1)).astype(np.int64), n


FEATURES = {"triples": triples, "words": words}


def _blocks(texts: list, most: int = 1 << 20):
    """(low, high) of texts that have some `most` characters together, one at least."""
    low, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= most:
            yield low, i + 1
            low, n = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _features(kind: str, bits: int, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(features of all texts, their number in each); null has none."""
    texts = [t or "" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return FEATURES[kind](codes, bits, np.array([len(t) for t in texts], np.int64))


class Bayes:
    """kind: triples or words; bits: features are numbered below 2 ** bits."""

    def __init__(self, kind: str, bits: int):
        self.kind, self.bits = kind, bits

    def fit(self, rows: DataFrame, text: str = "content", label: str = "label") -> DataFrame:
        """(label, feature, n): counts over all rows with a text and a label."""
        ship(rows.sparkSession)
        kind, bits = self.kind, self.bits

        def run(batches):
            counts: dict = {}
            for batch in batches:
                texts, names = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
                for low, high in _blocks(texts):
                    f, n = _features(kind, bits, texts[low:high])
                    mine = names[low:high]
                    for name in set(mine):
                        if name not in counts:
                            counts[name] = np.zeros(1 << bits, np.int64)
                        counts[name] += np.bincount(f[np.repeat(mine == name, n)], minlength=1 << bits)
            for name, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["label", "feature", "n"])

        source = rows.select(F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
        return source.mapInArrow(run, "label string, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))

    def weights(self, model: DataFrame) -> tuple[list[str], np.ndarray]:
        """(labels in order, their log probabilities of features)."""
        model = written(model)  # else it would be fitted twice
        if model.select("label").distinct().count() > MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} labels")
        found = model.toArrow()
        labels = sorted(set(found.column("label").to_pylist()))
        n = np.zeros((len(labels), 1 << self.bits))
        at = {name: i for i, name in enumerate(labels)}
        n[[at[x] for x in found.column("label").to_pylist()], found.column("feature").to_numpy()] = found.column("n").to_numpy()
        return labels, np.log((n + 1) / (n.sum(1, keepdims=True) + (1 << self.bits)))

    def score(self, df: DataFrame, model: DataFrame, text: str = "content", out: str = "guess", confidence: str = "confidence") -> DataFrame:
        """df with the likeliest label and its share of the likelihoods of all; null for texts without features.

        Equal likelihoods go to the first label. Columns of these names are replaced.
        """
        from pyspark.sql import types as T

        ship(df.sparkSession)
        labels, weights = self.weights(model)
        sent = df.sparkSession.sparkContext.broadcast(weights)
        kind, bits = self.kind, self.bits
        keep = [c for c in df.columns if c not in (out, confidence)]
        replaced = [] if text in keep else [F.col(f"`{text}`").alias("__bayes_in")]
        source = df.select(*[F.col(f"`{c}`") for c in keep], *replaced)
        at = keep.index(text) if text in keep else len(keep)
        schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField(out, T.StringType()), T.StructField(confidence, T.DoubleType())])

        def run(batches):
            w = sent.value
            for batch in batches:
                texts = batch.column(at).to_pylist()
                names, shares = [], []
                for low, high in _blocks(texts):
                    f, n = _features(kind, bits, texts[low:high])
                    known = np.flatnonzero(n) if labels else n[:0]
                    guess, share = np.full(high - low, None, object), np.full(high - low, None, object)
                    if len(known):
                        starts = (np.cumsum(n) - n)[known]
                        s = np.stack([np.add.reduceat(row[f], starts) for row in w])
                        best = s.argmax(0)
                        guess[known] = np.array(labels, object)[best]
                        share[known] = 1 / np.exp(np.maximum(s - s.max(0), -700)).sum(0)
                    names.extend(guess)
                    shares.extend(share)
                left = [batch.column(i) for i in range(len(schema) - 2)]
                yield pa.RecordBatch.from_arrays([*left, pa.array(names, pa.string()), pa.array(shares, pa.float64())], schema.names)

        return source.mapInArrow(run, schema)


LANGUAGES = Bayes("triples", 16)
SENTIMENT = Bayes("words", 18)


def log_probability(n: int, total: int, bits: int) -> float:
    """What a feature of n among total counts adds to a label's score."""
    return math.log((n + 1) / (total + (1 << bits)))
