"""The two classifiers against plain versions, and on rows that they have not learnt from."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest

from lexifold.llm import quality, queries, textblocks, toxicity


def test_ftrl_equals_a_plain_one():
    """One weight at a time in dictionaries, as the updates are published."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        ids = np.sort(rng.choice(400, rng.integers(1, 12), replace=False)).astype(np.int32)
        rows.append((int(rng.random() < 0.5 + 0.4 * (ids[0] < 60)), ids, rng.random(len(ids)).astype(np.float32)))
    rows.append((1, np.zeros(0, np.int32), np.zeros(0, np.float32)))  # an empty text
    alpha, beta, l1, l2, bias = 0.6, 1.0, 0.02, 0.02, 1 << quality.BITS
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(4):
        for r in order.permutation(len(rows)):
            y, ids, vals = rows[r]
            x = [*((i, float(v) * quality.SCALE) for i, v in zip(ids.tolist(), vals)), (bias, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[i] * v for i, v in x)))))
            for i, v in x:
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got, b = quality.fit_ftrl(rows)
    assert abs(b - weight(bias)) < 1e-5 and np.allclose(got[:400], [weight(i) for i in range(400)], atol=1e-5) and not got[400:].any() and np.count_nonzero(got) > 20


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(2)
    model = quality.QualityModel(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    texts = pa.array(["One two two THREE!!", "", None, "x", "a b c d e f g " * 50, "é 中文 12.5% ..."])
    batch = pa.RecordBatch.from_arrays([texts, pa.array([0] * len(texts), pa.int32())], ["text", "label"])
    sparse = [r for b in quality._sparse([batch]) for r in b.to_pylist()]
    for block in textblocks.blocks(texts):
        for r, s in zip(sparse, model.score_block(block)):
            ids, vals = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["vals"], np.float32)
            assert len(set(ids.tolist())) == len(ids)
            dot = sum(float(model.weights[i]) * float(v) for i, v in zip(ids, vals))
            assert abs(s - 1 / (1 + math.exp(-max(-30, min(30, 0.3 + quality.SCALE * dot))))) < 1e-6


def plain_trees(x, y, rounds, depth, rate, bins, least, ridge):
    """Every split of every node tried on its own rows."""
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for c in x.T]
    prior = min(max(y.mean(), 1e-3), 1 - 1e-3)
    f = np.full(len(y), math.log(prior / (1 - prior)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        part = [list(range(len(y)))]
        for _ in range(depth):
            new = []
            for rows in part:
                best, choice = 1e-6, None
                for j in range(x.shape[1]):
                    for c in cuts[j]:
                        left = [i for i in rows if x[i, j] <= c]
                        right = [i for i in rows if x[i, j] > c]
                        if len(left) < least or len(right) < least:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                        if gain > best + 1e-12:
                            best, choice = gain, (left, right)
                new += list(choice) if choice else [rows, []]
            part = new
        for rows in part:
            if rows:
                f[rows] += rate * g[rows].sum() / (h[rows].sum() + ridge)
    return f


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trees_equal_exhaustive_ones(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(90, 3)).round(1)
    y = ((x[:, 0] > 0.2) ^ (rng.random(90) < 0.15)).astype(float)
    how = dict(rounds=4, depth=2, rate=0.3, bins=6, least=8, ridge=2.0)
    got = toxicity.Trees.fit(x, y, **how).predict(x)
    assert np.allclose(got, plain_trees(x, y, **how), atol=1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_isotonic_equals_the_formula(seed):
    """The fit at a place is the greatest over all starts before it of the least mean up to any end behind it."""
    rng = np.random.default_rng(seed)
    x = np.sort(rng.integers(0, 12, 40)).astype(float)
    y = (rng.random(40) < x / 14).astype(float)
    groups = sorted(set(x.tolist()))
    s, n = np.array([y[x == v].sum() for v in groups]), np.array([(x == v).sum() for v in groups])
    k = len(groups)
    fit = [max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
    knots, values = toxicity.isotonic(x, y)
    shrunk = []
    for i in range(k):
        same = [j for j in range(k) if abs(fit[j] - fit[i]) < 1e-12]
        shrunk.append((s[same].sum() + 0.1) / (n[same].sum() + 0.2))
    assert np.allclose(np.interp(groups, knots, values), np.maximum.accumulate(shrunk), atol=1e-12)


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
@pytest.mark.parametrize("query,label,least", [("op1_toxicity", "toxic", 0.9), ("op9_quality_classifier", "quality", 0.9)])  # some labels are wrong
def test_rows_kept_aside(spark, query, label, least):
    got = getattr(queries, query)(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    assert len(rows) > 40 and sum(a == b for a, b in rows) / len(rows) >= least
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
