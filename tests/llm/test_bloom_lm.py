"""The Bloom filter language model against plain counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, frame

from lexifold.llm import bloom_lm as lm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]  # None: the end


class Plain:
    """The same model with dictionaries; hot contexts keep exact counts, others pass the logarithmic scale."""

    def __init__(self, texts):
        self.words, self.pairs, self.kinds, self.contexts = Counter(), Counter(), Counter(), Counter()
        for t in texts:
            row = tokens(t)
            self.words.update(row)
            for h, w in zip(["", *row[:-1]], row):
                self.kinds[h] += (h, w) not in self.pairs
                self.pairs[h, w] += 1
                self.contexts[h] += 1
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.hot = {h for h, n in self.words.items() if h is not None and n * lm.HOT >= self.n} | {""}

    def coarse(self, n):
        if n == 0:
            return 0.0
        code = 1 + math.floor(math.log(n) / math.log(1.5) + 1e-9)
        same = [m for m in range(1, 4 * n + 4) if 1 + math.floor(math.log(m) / math.log(1.5) + 1e-9) == code]
        return (same[0] + same[-1]) / 2

    def seen(self, counts, h):
        return counts[h] if h in self.hot else self.coarse(counts[h])

    def p(self, h, w):
        every = self.n + 0.5 * (self.v + 1)
        c = self.words[None] if w is None else self.seen(self.contexts, w)
        p = (c + 0.5) / every
        n = self.seen(self.contexts, h)
        if not n:
            return p
        kinds = max(1, min(self.seen(self.kinds, h), n))
        return (min(self.coarse(self.pairs[h, w]), n) + kinds * p) / (n + kinds)

    def score(self, text):
        row = tokens(text)
        return sum(math.log10(self.p(h, w)) for h, w in zip(["", *row[:-1]], row))

    def base(self, text):
        return sum(math.log10((self.words[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens(text))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def rows_to_try():
    rng = random.Random(11)
    vocabulary = [f"Wort{i}" for i in range(3000)]
    rows = [r for r in awkward() if len(r[1] or "") < 30000]
    for i in range(300):
        walk, at = [], rng.randrange(3000)
        for _ in range(rng.randrange(60)):
            at = (at * 7 + rng.choice([1, 1, 1, 2, rng.randrange(3000)])) % 3000
            walk.append(vocabulary[at])
        rows.append((3000 + i, " ".join(walk)))
    return rows


@pytest.mark.parametrize("options", [dict(bucket_tokens=500), dict(), dict(bucket_tokens=500, group_bytes=3000), dict(head=20, bucket_tokens=2000), dict(head=0)])
def test_equals_plain_counts(spark, options):
    """With so many hash functions that the filter never errs here; also over many buckets, in many passes and with rare words joined."""
    rows = rows_to_try()
    docs = frame(spark, rows).withColumn("held_out", lm.held_out())
    model = lm.BloomLM(docs.where("NOT held_out"), hashes=40, **options)
    if "group_bytes" in options:
        assert len(model.groups) > 2
    plain = Plain([t for i, t in rows if not held(i)])
    assert (model.tokens, model.types) == (plain.n, plain.v)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in model.score(docs, "doc_id").collect())
    want = Counter((i, len(tokens(t)), sum(plain.words[w] > 0 for w in tokens(t)), plain.n, round(plain.base(t), 6), round(plain.score(t), 6)) for i, t in rows)
    assert got == want


def test_report_and_clashing_columns(spark):
    rows = rows_to_try()
    got = lm.report(frame(spark, rows, ("row", "codes", "rare", "a", "n", "score", "c0", "has_rare", "held_out")))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    plain = Plain([t for i, t in rows if not held(i)])
    assert len(got) == len(rows)
    by_key = {(i, round(plain.base(t), 6)): t for i, t in rows}
    off = 0
    for r in got:
        t = by_key[r.doc_id, round(r.base_score, 6)]
        assert r.held_out == held(r.doc_id) and r.train_tokens == plain.n
        off += abs(r.score - plain.score(t)) > 0.05 * r.n_tokens + 0.5
    assert off < 0.05 * len(got)  # the filter errs in about a sixty-fourth of its answers
    mean = lambda key: sum(getattr(r, key) for r in got if r.held_out and r.doc_id >= 3000)
    assert mean("score") > mean("base_score") + 100  # pairs help with texts that were not learnt


def test_probabilities_sum_to_about_one(spark):
    rows = [(i, t) for i, t in rows_to_try() if not held(i)]
    plain = Plain([t for _, t in rows])
    sums = []
    for h in random.Random(1).sample(sorted(x for x in plain.contexts if x), 100):
        sums.append(sum(plain.p(h, w) for w in plain.words) + plain.p(h, "never seen"))
    assert 0.8 < min(sums) and max(sums) < 1.3 and abs(sum(sums) / len(sums) - 1) < 0.1


def test_never_too_low_and_seldom_too_high():
    rng = np.random.default_rng(2)
    items = lm.tb.mix(np.arange(20000, dtype=np.uint64))
    codes = lm.code(rng.zipf(1.7, 20000).clip(1, 10**6))
    group = lm.Group(1, [(0, *lm.segment(items, codes))])
    found = group.look_up(items, np.zeros(20000, np.int64))
    assert (found >= codes).all() and (found > codes).mean() < 0.04
    assert (group.look_up(lm.tb.mix(np.arange(10**6, 10**6 + 20000, dtype=np.uint64)), np.zeros(20000, np.int64)) > 0).mean() < 0.04


def test_codes_and_their_middles():
    n = np.arange(1, 3000)
    assert (np.abs(lm.MIDDLE[lm.code(n)] / n - 1) < 0.3).all() and lm.code(np.array([0]))[0] == 0 and lm.MIDDLE[0] == 0
    assert lm.MIDDLE[lm.code(np.array([1, 2, 3]))].tolist() == [1, 2, 3]


def test_empty_tables(spark):
    assert lm.report(frame(spark, [])).count() == 0
    (row,) = [r for r in lm.report(frame(spark, [(next(i for i in range(99) if held(i)), "only held out")])).collect()]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (4, 0, 0, 0.0, 0.0)


def test_answers_are_remembered_and_stay_right():
    """Slots that many items share, the item 0, several rows of codes: always the filter's answers, and frequent items are not asked again."""
    rng = np.random.default_rng(4)
    items = np.append(np.uint64(0), lm.tb.mix(np.arange(1, 3000, dtype=np.uint64)))
    codes = rng.integers(0, 30, (2, 3000)).astype(np.uint8)
    for bits in (1, 4, 11, 20):
        held, asked = lm.Remembered(bits), []
        for _ in range(12):
            some = rng.permutation(3000)[: rng.integers(0, 900)]

            def ask(i, some=some):
                asked.extend(some[i].tolist())
                return codes[:, some[i]]

            assert (held.look_up(items[some], ask) == codes[:, some]).all()
        if bits == 20:
            assert len(asked) < 1.01 * len(set(asked)) + 5
        if bits == 4:  # of those that share a slot the one that takes the most probes stays
            assert held.codes[0].min() == 29 or held.codes[0].mean() > 27


def test_probes_give_what_one_by_one_gives():
    rng = np.random.default_rng(6)
    items = lm.tb.mix(np.arange(30000, dtype=np.uint64))
    codes = lm.code(rng.zipf(1.5, 20000).clip(1, 10**6))
    bits, data = lm.segment(items[:20000], codes)
    group, found = lm.Group(1, [(0, bits, data)]), np.zeros(30000, int)
    flags = np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
    for level in range(1, 60):
        yes = found == level - 1
        a, b = lm._halves(items, level)
        for i in range(lm.HASHES):
            yes &= flags[lm._place(a, b, i, np.uint64(bits)).astype(np.int64)]
        found[yes] = level
    assert (group.look_up(items, np.zeros(30000, np.int64)) == found).all()
    # a second question about the same items asks the filter nothing
    asked = []
    for _ in range(2):
        got = group.remembered(items[:50], "x", 20, lambda i: (asked.append(len(i)), group.look_up(items[:50][i], np.zeros(len(i), np.int64))[np.newaxis])[1])
        assert (got[0] == found[:50]).all()
    assert sum(asked) == 50
