"""The registered queries and the pipeline over the small tables."""

import os

import pytest

from conftest import DATA
from lexifold.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name, tmp_path):
    got = queries.queries()[name](spark, DATA)
    got.write.parquet(str(tmp_path / "out"))
    duck.execute(f"CREATE OR REPLACE TABLE want AS {queries.oracle_sql()[name]}")
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = sorted(c[0] for c in duck.execute("DESCRIBE want").fetchall())
    assert columns == sorted(got.columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"SELECT {', '.join(columns)} FROM {a} EXCEPT ALL SELECT {', '.join(columns)} FROM {b} LIMIT 3").fetchall() == []


def test_names():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {f"{n.split('_')[0]}_" for n in names if n.startswith("op")} and "pipeline" in names


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version over the rows that it was given."""
    import re

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs)
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns
    text = [{r.doc_id: r.text for r in s.collect()} for s in seen[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    wrong = [i for i in text[0] if i in labels and (i in text[1]) != (labels[i] == 1)]
    assert len(wrong) <= 0.03 * len(labels)

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in text[1].items() if (w := words(t))}
    near = lambda a, b: 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])
    ids = sorted(grams)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and near(a, b) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    assert set(text[2]) == {i for i in text[1] if group.get(i, i) == i}

    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for t in bench for w in [plain(t)] for k in range(max(1, len(w) - 9))}
    for i, t in text[2].items():
        w = plain(t)
        hit = any(tuple(w[k : k + 10]) in windows for k in range(len(w)))
        if not hit:
            assert text[3][i] == t
        elif i in text[3]:
            assert text[3][i] != t

    assert set(text[4]) == set(text[3])
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", t or "") for t in text[4].values())
    from tokenizers import Tokenizer

    from lexifold.llm import tokens

    library, packed = Tokenizer.from_file(tokens.default_path()), {}
    for r in seen[-1].collect():
        for p in r.parts:
            packed.setdefault(p.doc_id, []).append((p.start, r.ids[p.bin_start : p.bin_start + p.n_tokens]))
    assert {i: sum((x for _, x in sorted(parts)), []) for i, parts in packed.items()} == {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in text[4].items()}


def test_run_gives_the_last_stage(spark):
    import corpus_pipeline as p

    assert set(p.run(spark, DATA).columns) == {"bin_id", "capacity", "n_ids", "ids", "parts"}
