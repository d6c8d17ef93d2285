"""Stages of the caller's own, sources of records, paged sources."""

import json

from lexifold.plans import hooks, stages  # noqa: F401
from lexifold.plans.pipeline import Context, compile_pipeline, spec
from lexifold.sources import paged


def table(spark):
    return spark.createDataFrame([(1, "a b", ["x"]), (2, None, None), (3, "", []), (4, "c", ["y", "z"])], "id long, content string, tags array<string>")


def test_a_stage_that_gives_none_one_or_many(spark):
    def split(record, sign="?"):
        """Words of content."""
        if record["content"] is None:
            return None
        if record["id"] == 4:
            return {"content": record["content"] + sign, "place": 0}
        return ({"content": w, "place": i} for i, w in enumerate(record["content"].split()))

    hooks.resolving("SplitWords", split, "place int")
    steps = json.dumps([["SplitWords", {"arguments": {"sign": "!"}}], ["FilterOut", {"cond": "place == 1"}]])
    got = compile_pipeline(table(spark), steps)
    assert got.columns == ["id", "content", "tags", "place"]
    assert sorted((r.id, r.content, r.tags, r.place) for r in got.collect()) == [(1, "a", ["x"], 0), (4, "c!", ["y", "z"], 0)]
    assert spec("SplitWords")["doc"] == "Words of content."
    assert compile_pipeline(table(spark).limit(0), steps).count() == 0


def test_a_summary(spark):
    class Longest(hooks.Summary):
        """The number of records, and the longest content with its id."""

        def start(self):
            return (0, -1, None)

        def add(self, state, record):
            n, size, name = state
            own = len(record["content"] or "")
            return (n + 1, own, record["id"]) if (own, -record["id"]) > (size, -(name or 0)) else (n + 1, size, name)

        def merge(self, a, b):
            best = max(a, b, key=lambda s: (s[1], -(s[2] or 0)))
            return (a[0] + b[0], *best[1:])

        def finish(self, state):
            return {"n": state[0], "id": state[2]}

    hooks.summarising("Longest", Longest(), "n long, id long")
    many = spark.range(1000).selectExpr("id", "repeat('x', cast(id % 97 AS int)) AS content").repartition(150)
    (row,) = compile_pipeline(many, [["Longest", {}]]).collect()
    assert tuple(row) == (1000, 96)
    (row,) = compile_pipeline(many.limit(0), [["Longest", {}]]).collect()
    assert tuple(row) == (0, None)


def test_sources_of_ten_thousand_records(spark):
    def fetch(params):
        return [{"content": f"{params['base']}-{params['id']}-{i}", "n": i} for i in range(params["id"] % 3)]

    df = spark.range(10_000).selectExpr("id", "if(id % 2 = 0, 'own', null) AS base")
    got = compile_pipeline(df, [["RecordDataSource", {"source": "small", "fields": "content string, n int", "params": {"base": "given"}}]], Context(constants={"source:small": fetch}))
    rows = got.collect()
    assert len(rows) == sum(i % 3 for i in range(10_000)) and got.rdd.getNumPartitions() > 1
    assert {r.content for r in rows if r.id == 5} == {"given-5-0", "given-5-1"} and {r.content for r in rows if r.id == 8} == {"own-8-0", "own-8-1"}


def test_pages_side_by_side(spark):
    got = paged.read(spark, "numbers", lambda start, limit: [f"item {i}" for i in range(start, start + limit)], lambda: 1003, limit=50)
    assert sorted((r.position, r.content) for r in got.collect()) == [(i, f"item {i}") for i in range(1003)]
    assert got.rdd.getNumPartitions() == 21
    assert paged.read(spark, "nothing", lambda start, limit: [], lambda: 0).count() == 0


def test_a_stream_goes_on_from_its_offset(spark, tmp_path):
    grown = str(tmp_path / "size")

    def size():
        return int(open(grown).read())

    def run(n):
        (tmp_path / "size").write_text(str(n))
        df = paged.follow(spark, "growing", lambda start, limit: [f"item {i}" for i in range(start, start + limit)], size, limit=7)
        q = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(60)
        return sorted(r.position for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run(30) == list(range(30))
    assert run(45) == list(range(45))  # each item once, after a restart
