"""A table kept by a stream of changes."""

import os
import random

import pytest

from lexifold.streaming import changes

SCHEMA = "path string, at long, kind string, size long"


def final(rows):
    """The plain version: the last change of each key."""
    last = {}
    for path, at, kind, size in rows:
        if path is None or at is None or kind not in ("upsert", "delete"):
            continue
        rank = (at, kind == "delete", size is not None, str(size))
        if path not in last or rank > last[path][0]:
            last[path] = rank, (path, size) if kind == "upsert" else None
    return sorted((v for _, v in last.values() if v), key=str)


def batches_of(seed, n=6):
    rng = random.Random(seed)
    out = []
    for b in range(n):
        rows = [(f"f{rng.randrange(40)}", rng.randrange(b * 10, b * 10 + 30), rng.choice(["upsert", "upsert", "delete"]), rng.randrange(5)) for _ in range(25)]
        out.append(rows + rows[:5])  # repeated changes
    out[1].append((None, 1, "upsert", 1))
    out[1].append(("f1", None, "upsert", 1))
    out[2].append(("x", 5, "unknown", 1))
    out[2].append(("null size", 5, "upsert", None))
    return out


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")


def test_replay_gives_the_plain_result(spark, folders):
    source, path, check = folders
    table = changes.Table(spark, path, "path string, size long", buckets=8)
    every = []
    for part in (batches_of(1)[:3], batches_of(1)[3:]):  # stopped and started again in between
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            every += rows
        table.keep(changes.follow(spark, source, SCHEMA, files_a_batch=1), check).awaitTermination()
        assert sorted(map(tuple, table.read().collect()), key=str) == final(every)


def test_only_changed_buckets_are_written(spark, folders):
    source, path, check = folders
    table = changes.Table(spark, path, "path string, size long", buckets=16)
    spark.createDataFrame([(f"f{i}", 1, "upsert", i) for i in range(200)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    table.keep(changes.follow(spark, source, SCHEMA), check).awaitTermination()
    spark.createDataFrame([("f7", 2, "upsert", 700), ("f8", 0, "upsert", 1), ("f9", 3, "upsert", 9)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    table.keep(changes.follow(spark, source, SCHEMA), check).awaitTermination()
    written = [d for d in os.listdir(f"{path}/rows/batch=1") if d.startswith("bucket=")]
    assert len(written) == 1  # f8 is late, f9 says nothing new
    assert table.read().where("path = 'f7'").first().size == 700 and table.read().count() == 200


def test_a_batch_may_run_again(spark, folders):
    _, path, _ = folders
    table = changes.Table(spark, path, "path string, size long", buckets=4)
    first = spark.createDataFrame([("a", 1, "upsert", 1), ("b", 1, "upsert", 2)], SCHEMA)
    second = spark.createDataFrame([("a", 2, "delete", None), ("c", 2, "upsert", 3)], SCHEMA)
    for _ in range(2):
        table.apply(first, 0)
    for _ in range(2):
        table.apply(second, 1)
    assert sorted(map(tuple, table.read().collect())) == [("b", 2), ("c", 3)]
    assert table.apply(second.limit(0), 2) == set()


def test_batches_are_bounded(spark, folders):
    source, path, check = folders
    for i in range(5):
        spark.createDataFrame([(f"f{i}", 1, "upsert", i)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    table = changes.Table(spark, path, "path string, size long", buckets=2)
    q = table.keep(changes.follow(spark, source, SCHEMA, files_a_batch=2), check)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 3 and table.read().count() == 5


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = changes.Row("at", "kind", "size")(*v)

    def clear(self):
        self.v = None


class _Handle:
    def __init__(self):
        self.value, self.timers = _Value(), []

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.append(at)


class _Now:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_a_timer_forgets_a_deletion():
    from pyspark.sql import types as T

    kinds = {"at": T.LongType(), "kind": T.StringType(), "size": T.LongType()}
    one, handle = changes.Latest("path", "at", ["size"], kinds, 50), _Handle()
    one.init(handle)
    tell = lambda *rows: [tuple(r) for r in one.handleInputRows(("a",), [dict(zip(("at", "kind", "size"), r)) for r in rows], _Now())]
    assert tell((1, "upsert", 5)) == [("a", 1, "upsert", 5)] and tell((1, "upsert", 5)) == [] and tell((2, "upsert", 5)) == []
    assert tell((4, "delete", None), (3, "upsert", 7)) == [("a", 4, "delete", None)] and handle.timers == [1050]
    assert tell((4, "upsert", 9)) == []  # late
    one.handleExpiredTimer(("a",), _Now(), None)
    assert not handle.value.exists() and tell((1, "delete", None)) == []
