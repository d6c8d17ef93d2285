"""The stored vector index against all cosines."""

import math
import random

import numpy as np
import pytest

from conftest import DATA
from lexifold import catalog, folders
from lexifold.operators import ann, vectors
from lexifold.plans import q_vectors


def clustered(n=3000, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, dim))
    return [(int(i), (centre[rng.integers(40)] + 0.25 * rng.normal(size=dim)).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


def queries(df, every=50):
    return df.where(f"id % {every} = 0").selectExpr("id AS query_id", "v")


def test_recall_with_few_lists(spark):
    df = frame(spark, clustered())
    index = ann.temporary(df)
    q = queries(df)
    right = vectors.nearest(df, q, 10)
    assert ann.recall(index.search(q, 10, probes=6), right) >= 0.9
    assert ann.recall(index.search(q, 10, probes=len(index.model.lists)), right) >= 0.97


def test_exact_equals_all_cosines(spark):
    rows = clustered(600) + [(10_000 + i, [1.0] * 16) for i in range(30)]  # ties
    df = frame(spark, rows)
    index = ann.temporary(df)
    got = index.exact(queries(df), 7).collect()
    want = vectors.nearest(df, queries(df), 7).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == sorted((r.query_id, r["rank"], r.id) for r in want)
    assert all(abs(a.cosine - b.cosine) < 1e-6 for a, b in zip(sorted(got), sorted(want)))


def test_scan_reads_only_the_probed_partitions(spark):
    df = frame(spark, clustered())
    index = ann.temporary(df)
    found = index.search(queries(df, 3000), 5, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = index.rows(index.near_lists(ann.unit(np.array([clustered()[0][1]])), 2)[0].tolist())
    assert 0 < len(read.inputFiles()) and read.count() < 0.3 * 3000


def test_every_row_is_indexed_and_odd_rows_are_not(spark):
    odd = [(1, None), (2, []), (3, [0.0] * 4), (4, [math.nan, 1.0, 1.0, 1.0]), (5, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (6, [math.inf, 1.0, 1.0, 1.0])]
    rng = random.Random(0)
    fine = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(100, 300)] + [(100, [1.0, 2.0, 3.0, 4.0])]
    index = ann.temporary(frame(spark, odd + fine))
    assert sorted(r.id for r in spark.read.parquet(f"{index.path}/rows").collect()) == sorted(i for i, _ in fine)
    got = index.exact(frame(spark, [(7, [1.0, 2.0, 3.0, 4.0]), (8, None)]).withColumnRenamed("id", "query_id"), 1).collect()
    assert [(r.query_id, r.id) for r in got] == [(7, 100)]


def test_empty(spark):
    df = frame(spark, clustered(200))
    assert ann.temporary(df).search(queries(df.limit(0)), 5).count() == 0


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_recall_of_the_registered_query(spark, folder):
    e = catalog.embeddings(spark, folder)
    right = vectors.nearest(e, e.where("id % 50 = 0").selectExpr("id AS query_id", "v"), 10)
    assert ann.recall(q_vectors.ann_topk(spark, folder), right) >= 0.9


def test_strings_as_ids(spark):
    df = frame(spark, clustered(300)).selectExpr("concat('p', id) AS id", "v")
    q = df.where("id = 'p7'").selectExpr("id AS query_id", "v")
    (first, *_) = ann.temporary(df).exact(q, 3).orderBy("rank").collect()
    assert first.id == "p7" and abs(first.cosine - 1) < 1e-6


def test_once_builds_once(spark):
    made = []
    for _ in range(2):
        folders.once(spark, ("x", "same"), made.append)
    assert len(made) == 1
