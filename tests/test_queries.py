"""Every registered query of the engine against DuckDB over the same tables."""

import pytest

from conftest import DATA
from lexifold.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name, tmp_path):
    got = catalogue.queries()[name](spark, DATA)
    got.write.parquet(str(tmp_path / "out"))
    if name not in SQL:
        assert spark.read.parquet(str(tmp_path / "out")).count() > 0
        return
    duck.execute(f"CREATE OR REPLACE TABLE want AS {SQL[name]}")
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = sorted(c[0] for c in duck.execute("DESCRIBE want").fetchall())
    assert columns == sorted(got.columns)
    cols = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


NO_PYTHON = [n for n in SQL if n not in ("pairwise_cosine", "cosine_components", "topk_edges_components", "knn_topk", "outline_running", "rerank_fake")]


@pytest.mark.parametrize("name", ["kw_prefix", "tfidf", "ngram_counts", "calibre_star_join", "chunk_windows", "crawl_bfs", "dedup_merge_latest", "text_clean"])
def test_plan_stays_in_the_jvm(spark, name):
    assert name in NO_PYTHON
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_scans_are_pruned_and_pushed_down(spark):
    plan = catalogue.queries()["lang_in"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lang, [de,fr])]" in plan and "n_chars" not in plan
