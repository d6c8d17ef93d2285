"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text: densities and counts of a given and of a learned lexicon,
hits near a second person, hits that appear only after undoing character
substitutions, shares of capitals, all-capital words, punctuation, exclamation
marks, digits inside words, masked letters and stretched letters, and sizes.
All are computed on whole texts with array kernels; null and empty texts have
no words and get the score of a text without any evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .labelled import held_out, training_rows

U = np.uint64

SEED_LEXICON = (
    "idiot idiots stupid moron morons loser losers pathetic trash scum clown worthless disgusting dumb ugly garbage fool fools jerk "
    "hate kill die shut crap damn hell vermin filth filthy creep freak imbecile coward liar pig rat worm useless ignorant retard "
    "dumm blöd idiota estúpido estúpida imbécil basura tonto tonta asqueroso stupide imbécile crétin débile ordure nul dégoûtant "
    "dummkopf trottel abschaum müll wertlos hässlich ekelhaft"
).split()
SECOND_PERSON = "you your yours yourself u ur youre du dich dir dein deine tu te toi ton ta vous votre usted tú ti su".split()
REACH = 5  # words between a hit and a second person

_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LEET_KIND = tb.LETTER | tb.table_of(lambda b: chr(b) in _LEET)
_LEET_VALUES = tb.LOWER.copy()
for _a, _b in _LEET.items():
    _LEET_VALUES[ord(_a)] = tb.LOWER[ord(_b)]

_UPPER = tb.table_of(lambda b: 65 <= b <= 90)
_LOWERCASE = tb.table_of(lambda b: 97 <= b <= 122)
_PUNCT = tb.table_of(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)
_DIGIT = tb.table_of(lambda b: 48 <= b <= 57)
_MASK = tb.table_of(lambda b: chr(b) in "*#_")

NAMES = (
    "given_rate given_count learned_rate learned_count learned_weight near_second near_second_rate disguised disguised_rate second_rate "
    "upper_share caps_words punct_share exclaim_share digit_in_word masked stretched mean_word log_words log_bytes hit_lines"
).split()


def _hashes(words, values=tb.LOWER):
    return np.unique(np.array([tb.word_hash(w, values) for w in words], U))


def _member(h, table):
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h


class Lexicon:
    """given: hashes of listed words; learned: hashes found in the labelled sample, with their log odds."""

    def __init__(self, learned: np.ndarray, weight: np.ndarray):
        order = np.argsort(learned)
        self.learned, self.weight = learned[order], weight[order]
        self.given, self.second = _hashes(SEED_LEXICON), _hashes(SECOND_PERSON)
        self.spelled = np.unique(np.concatenate((self.given, self.learned)))

    def features(self, block: tb.Block) -> np.ndarray:
        buf = block.buf
        starts, ends, h, first = tb.words(block, tb.LETTER)
        n = np.diff(first)
        per = np.maximum(n, 1)
        size = np.maximum(np.diff(block.off) - 1, 1)
        total = lambda x: tb.segment_sums(x.astype(np.float64), first)
        share = lambda kind: tb.segment_sums(kind[buf].astype(np.float64), block.off)
        given, second = _member(h, self.given), _member(h, self.second)
        learned = _member(h, self.learned)
        weight = np.zeros(len(h))
        if learned.any():
            weight[learned] = self.weight[np.searchsorted(self.learned, h[learned])]
        hit = given | learned
        # a hit with a second person at most REACH words away in the same document
        seen = np.concatenate(([0], np.cumsum(second)))
        doc = tb.segment_ids(first)
        at = np.arange(len(h))
        near = hit & (seen[np.minimum(at + REACH + 1, first[doc + 1])] - seen[np.maximum(at - REACH, first[doc])] > 0)
        # words with substituted characters
        ls, le = tb.spans(_LEET_KIND[buf])
        lh = tb.span_hash(tb.prefix_sums(buf, _LEET_VALUES), ls, le)
        lfirst = np.searchsorted(ls, block.off)
        spelled = _member(lh, self.spelled)
        disguised = np.maximum(tb.segment_sums(spelled.astype(np.float64), lfirst) - total(hit), 0)
        count = lambda kind: np.concatenate(([0], np.cumsum(kind[buf], dtype=np.int64)))
        upper, lower = count(_UPPER), count(_LOWERCASE)
        caps = (upper[ends] - upper[starts] > 1) & (lower[ends] == lower[starts])
        letters = tb.LETTER[buf]
        inside = np.zeros(len(buf), bool)
        masked = np.zeros(len(buf), bool)
        stretched = np.zeros(len(buf), bool)
        if len(buf) > 2:
            inside[1:-1] = _DIGIT[buf[1:-1]] & letters[:-2] & letters[2:]
            masked[1:-1] = _MASK[buf[1:-1]] & letters[:-2] & letters[2:]
            stretched[2:] = letters[2:] & (buf[2:] == buf[1:-1]) & (buf[2:] == buf[:-2])
        by_doc = lambda x: tb.segment_sums(x.astype(np.float64), block.off)
        line = np.concatenate(([0], np.cumsum(buf == 10)))
        hit_line = np.where(hit, line[starts], -1)
        new_line = hit & (hit_line != np.concatenate(([-1], np.maximum.accumulate(hit_line)[:-1])))
        cols = [
            total(given) / per, total(given), total(learned) / per, total(learned), total(weight) / per, total(near), total(near) / per, disguised, disguised / per,
            total(second) / per, share(_UPPER) / size, total(caps) / per, share(_PUNCT) / size, by_doc(buf == 33) / size, by_doc(inside) / per, by_doc(masked) / per,
            by_doc(stretched) / per, total(ends - starts) / per, np.log1p(n), np.log1p(size), total(new_line),
        ]
        return np.stack(cols, 1)


def learn_lexicon(rows, least: int = 6, ratio: float = 3.0, most: int = 400) -> Lexicon:
    """Words whose documents are toxic far more often than others. rows: (label, hashes of distinct words)."""
    toxic = sum(y for y, _ in rows)
    clean = len(rows) - toxic
    if not toxic or not clean:
        return Lexicon(np.zeros(0, U), np.zeros(0))
    words, where = np.unique(np.concatenate([w for _, w in rows]), return_inverse=True)
    label = np.repeat(np.array([y for y, _ in rows]), [len(w) for _, w in rows])
    bad = np.bincount(where, weights=label, minlength=len(words))
    good = np.bincount(where, minlength=len(words)) - bad
    odds = np.log((bad + 0.5) / (toxic + 1)) - np.log((good + 0.5) / (clean + 1))
    spread = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    keep = np.flatnonzero((bad >= least) & (odds / spread > ratio) & (odds > 1))
    keep = keep[np.lexsort((words[keep], -(odds / spread)[keep]))[:most]]
    return Lexicon(words[keep], odds[keep])


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def __init__(self, edges, trees, start):
        self.edges, self.trees, self.start = edges, trees, start

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds=80, depth=3, rate=0.12, bins=32, least=12, ridge=2.0):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = float(np.log(prior / (1 - prior)))
        f = np.full(len(y), start)
        trees = []
        width = bins + 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            tree = []
            for level in range(depth):
                n = 1 << level
                best = np.full(n, 1e-6)
                split = np.full(n, -1)
                at = np.zeros(n, np.int64)
                for j in range(x.shape[1]):
                    slot = node * width + b[:, j]
                    gs = np.bincount(slot, weights=g, minlength=n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(slot, weights=h, minlength=n * width).reshape(n, width).cumsum(1)
                    cs = np.bincount(slot, minlength=n * width).reshape(n, width).cumsum(1)
                    gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                    gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    gain[(cs < least) | (ct - cs < least)] = 0
                    k = gain.argmax(1)
                    v = gain[np.arange(n), k]
                    better = v > best
                    best[better], split[better], at[better] = v[better], j, k[better]
                tree.append((split, at))
                feature = np.maximum(split[node], 0)
                right = (split[node] >= 0) & (b[np.arange(len(y)), feature] > at[node])
                node = node * 2 + right
            n = 1 << depth
            value = rate * np.bincount(node, weights=g, minlength=n) / (np.bincount(node, weights=h, minlength=n) + ridge)
            f += value[node]
            trees.append((tree, value))
        return cls(edges, trees, start)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        f = np.full(len(x), self.start)
        every = np.arange(len(x))
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for split, at in tree:
                feature = np.maximum(split[node], 0)
                node = node * 2 + ((split[node] >= 0) & (b[every, feature] > at[node]))
            f += value[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray):
    """(knots, values): the non-decreasing fit of y on x by pooling adjacent violators, shrunk a little."""
    places, of = np.unique(x, return_inverse=True)  # rows at one place are one block from the start
    blocks: list[list[float]] = []  # sum, count, least x, greatest x
    for a, total, n in zip(places.tolist(), np.bincount(of, weights=y).tolist(), np.bincount(of).tolist()):
        blocks.append([total, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    knots = np.array([v for s, n, lo, hi in blocks for v in ((lo, hi) if hi > lo else (lo,))])
    values = np.array([(s + 0.1) / (n + 0.2) for s, n, lo, hi in blocks for _ in range(2 if hi > lo else 1)])
    return knots, np.maximum.accumulate(values)


class ToxicityModel:
    def __init__(self, lexicon, trees, knots, values):
        self.lexicon, self.trees, self.knots, self.values = lexicon, trees, knots, values

    def score_block(self, block: tb.Block) -> np.ndarray:
        raw = self.trees.predict(self.lexicon.features(block))
        calibrated = np.interp(raw, self.knots, self.values)
        # the calibrated steps alone would tie many texts: the raw margin breaks ties within them
        return np.clip(calibrated * 0.999 + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 8000) -> ToxicityModel:
    """Learns lexicon, trees and calibration from at most `most` labelled rows, never from held-out ones.

    The lexicon and the trees come from different folds' rows: each fold's
    margins for calibration are of trees and words that did not see it.
    """
    tb.ship(docs.sparkSession)

    def words(batches):
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                _, _, h, first = tb.words(block, tb.LETTER)
                got = [np.unique(h[first[i] : first[i + 1]]).tobytes() for i in range(len(block))]
                yield pa.RecordBatch.from_arrays([c.slice(block.rows.start, len(block)) for c in batch.columns] + [pa.array(got, pa.binary())], [*batch.schema.names, "words"])

    rows = training_rows(docs, labels, label, most).select("label", "text").mapInArrow(words, "label int, text string, words binary").toArrow()
    text = rows.column("text").combine_chunks().fill_null("")
    y = rows.column("label").to_numpy().astype(float)
    # an order and folds that depend on the texts alone
    sums = np.array([np.frombuffer(w.as_py(), U).sum(dtype=U) for w in rows.column("words")] or [], U)
    order = np.lexsort((y, tb.mix(sums)))
    y = y[order]
    word_sets = [np.frombuffer(rows.column("words")[int(i)].as_py(), U) for i in order]
    blocks = [b for b in tb.blocks(text.take(pa.array(order)))]
    table = lambda lexicon: np.concatenate([lexicon.features(b) for b in blocks]) if blocks else np.zeros((0, len(NAMES)))
    fold = np.arange(len(y)) % 3
    if len(y) < 30 or y.min() == y.max():
        lexicon = Lexicon(np.zeros(0, U), np.zeros(0))
        trees = Trees([np.zeros(0)] * len(NAMES), [], 0.0)
        return ToxicityModel(lexicon, trees, np.array([0.0]), np.array([float(y.mean()) if len(y) else 0.5]))
    margins = np.zeros(len(y))
    for k in range(3):
        # learned words are noted on other rows than those the trees then see them on
        halves = np.arange(len(y)) // 3 % 2
        train = fold != k
        x = np.zeros((len(y), len(NAMES)))
        for half in range(2):
            lexicon = learn_lexicon([(y[i], word_sets[i]) for i in np.flatnonzero(train & (halves != half))])
            part = halves == half
            x[part] = table(lexicon)[part]
        margins[~train] = Trees.fit(x[train], y[train]).predict(x[~train])
    x = np.zeros((len(y), len(NAMES)))
    for k in range(3):
        x[fold == k] = table(learn_lexicon([(y[i], word_sets[i]) for i in np.flatnonzero(fold != k)]))[fold == k]
    trees = Trees.fit(x, y)
    return ToxicityModel(learn_lexicon(list(zip(y, word_sets))), trees, *isotonic(margins, y))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """docs with score (double) and predicted (int, score >= threshold) added or replaced."""
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
