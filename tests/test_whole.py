"""Registered queries pass whole texts and whole vocabularies through their stages."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lexifold.operators import counts
from lexifold.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with three texts, the first of 700 words, and their tokens by id."""
    at = str(tmp_path_factory.mktemp("whole"))
    rng = np.random.default_rng(6)
    texts = {1: " ".join(f"w{i}" for i in rng.integers(0, 300, 700)), 2: "w1 w2 w1 other w2 words here", 3: ""}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at, {i: re.findall(r"\w+", t) for i, t in texts.items()}


def test_cooccurrence_takes_whole_texts(spark, tables):
    at, tokens = tables
    want = Counter(p for t in tokens.values() for p in combinations(t, 2))
    got = catalogue.queries()["cooccurrence_tokens"](spark, at)
    assert {(r.a, r.b): r.n for r in got.collect()} == want


def test_cooccurrence_of_odd_records(spark):
    df = spark.createDataFrame([(["x"] * 1000,), (["a", None, "a"],), ([],), (None,), (["b"],)], "tokens array<string>")
    want = {("x", "x"): 499500, ("a", None): 1, ("a", "a"): 1, (None, "a"): 1}
    assert {(r.a, r.b): r.n for r in counts.cooccurrence(df).collect()} == want


def test_array_stages_take_all_tokens(spark, tables):
    at, tokens = tables
    got = {r.id: r.tokens for r in catalogue.queries()["array_push"](spark, at).collect()}
    assert {int(i): t for i, t in got.items()} == {i: " ".join([*t, "x", "en"]) for i, t in tokens.items()}
    want = {(i, f"{w}!"): n for i, t in tokens.items() for w, n in Counter(t).items()} | {(i, None): 1 for i in tokens}
    got = catalogue.queries()["foreach_explode"](spark, at)
    assert {(int(r.id), r.w): r.n for r in got.collect()} == want


def test_bow_numbers_all_words(spark, tables):
    at, tokens = tables
    dim, want = {}, {}
    for i, t in tokens.items():
        c = Counter(dim.setdefault(w, len(dim)) for w in t)
        want[i] = " ".join(f"{k}:{c[k]}" for k in sorted(c))
    got = {int(r.id): r.vec for r in catalogue.queries()["bow_vectors"](spark, at).collect()}
    assert len(dim) > 200 and got == want  # the empty text has an empty vector
    few = counts.bag_of_words(spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, None)], "id long, tokens array<string>"), 1)
    assert {r.id: r.vec for r in few.collect()} == {1: {0: 1}, 2: {}, 3: {}}


def test_lda_uses_all_words(spark, tables, monkeypatch):
    from pyspark.ml.feature import CountVectorizerModel

    at, tokens = tables
    seen, plain = [], CountVectorizerModel.transform
    monkeypatch.setattr(CountVectorizerModel, "transform", lambda self, *a, **k: seen.append(len(self.vocabulary)) or plain(self, *a, **k))
    assert catalogue.queries()["lda_topics"](spark, at).count() == len(tokens)
    assert seen == [len({w for t in tokens.values() for w in t})]
