"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest

from conftest import DATA
from lexifold.llm import hard_negatives, queries
from lexifold.llm.vptree import VPTree, distances


def fits(score):
    return max(-(2**63), min(2**63 - 1, score))


def wanted(rows, every=100, positives=5, k=5):
    """rows: (vec_id, label, embedding)."""
    good = [(i, lab, [math.floor(256 * np.float32(x).item()) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in good]
    out = []
    for a, (ai, al, av) in enumerate(good):
        if ai % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, r, lab) for r, (i, lab, v) in enumerate(good) if r != a and len(v) == len(av))
        for ps, pi, _, _ in [x for x in scored if x[3] == al][:positives]:
            inside = [x for x in scored if x[3] != al and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:k]
            out += [(ai, pi, n, i, fits(-ps), fits(-s)) for n, (s, i, _, _) in enumerate(inside, 1)]
    return sorted(out)


def rows_to_try(n, dim=6, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = centres[rng.randrange(12)]
        rows.append((i, rng.randrange(4), [x + rng.gauss(0, 0.2) for x in c]))
    rows += [(i, i % 3, centres[0]) for i in range(n, n + 120)]  # equal vectors: ties everywhere
    rows += [(100, 1, [0.5] * dim), (100, 2, [0.4] * dim), (100, 1, [0.5] * dim), (7, 1, [0.3] * dim)]  # shared ids
    rows += [(900, 1, [1.0] * 3), (901, 1, [0.5] * 3), (902, 2, [0.45] * 3), (903, None, [1.0] * dim), (904, 1, None), (905, 1, [None] * dim), (906, 1, [math.nan] * dim), (907, 1, [math.inf] * dim), (908, 1, []), (None, 1, [1.0] * dim)]
    rows += [(-200, 2, [0.1] * dim), (1000, 9, [2.0] * dim), (1100, 1, [0.0] * dim), (1200, 0, [1e9] * dim), (1201, 1, [9e8] * dim), (1203, 0, [1e9] * dim)]
    rng.shuffle(rows)
    return rows


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("shard_rows,leaf", [(50, 8), (8192, 512), (100, 1)])
def test_equals_all_scores(spark, shard_rows, leaf):
    rows = rows_to_try(400)
    table = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine(hard_negatives.relabelled(table), shard_rows=shard_rows, leaf=leaf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == wanted(rows)


def test_empty_and_without_anchors(spark):
    assert hard_negatives.mine(hard_negatives.relabelled(spark.createDataFrame([], SCHEMA))).count() == 0
    assert hard_negatives.mine(hard_negatives.relabelled(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [2.0])], SCHEMA))).count() == 0


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = rows_to_try(150)
    table = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "cell", "v", "shard", "kind"):
        table = table.withColumn(c, F.lit("mine"))
    assert sorted(tuple(r) for r in queries_on(table).collect()) == wanted(rows)


def queries_on(table):
    return hard_negatives.mine(hard_negatives.relabelled(table), shard_rows=64, leaf=16)


def test_query_equals_sql(spark, duck, tmp_path):
    queries.op12_hard_negatives(spark, DATA).write.parquet(str(tmp_path / "out"))
    got = duck.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM '{tmp_path}/out/*.parquet' ORDER BY ALL").fetchall()
    assert got == duck.execute(f"SELECT * FROM ({hard_negatives.ORACLE}) ORDER BY ALL").fetchall() and got


def test_annulus_leaves_out_most_of_a_clustered_space():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(10 * i, 0.1, (200, 5)) for i in range(20)])
    tree = VPTree(points, 50)
    q = points[0]
    d = distances(points, q)
    near, far = 20.0, 25.0
    seen = np.concatenate(list(tree.pages(q, near, lambda: far)))
    assert set(np.flatnonzero((d >= near) & (d <= far))) <= set(seen.tolist()) and len(seen) < 0.3 * len(points)


def test_routes_agree_with_bounds():
    rng = np.random.default_rng(4)
    upper = VPTree(rng.normal(size=(300, 4)), 40, whole_space=True)
    points = rng.normal(size=(2000, 4)) * 2
    cell = upper.route(points)
    for q in points[:40]:
        d = distances(points, q)
        for near, far in ((0, 1.0), (1.0, 2.5), (3.0, math.inf)):
            assert set(cell[(d >= near) & (d <= far)]) <= set(upper.leaves_within(q, near, far))
