"""The keyword index against the predicate over arrays."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from lexifold import catalog, folders
from lexifold.operators import inverted
from lexifold.plans import q_search
from lexifold.plans.keywords import evaluate, matches, parse

VOCABULARY = "a ab abc abd b ba bab c ca cab d über übel 中文 x%y o'clock".split()


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    rows = [(i, rng.sample(VOCABULARY, rng.randrange(len(VOCABULARY)))) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [None, "a"]), (None, ["a"]), (5, ["only", "twice"]), (5, ["twice"])]
    df = spark.createDataFrame(rows, "id long, keywords array<string>")
    return rows, df, inverted.Index.build(df, folders.scratch(spark, "keywords"), buckets=3)


_word = st.sampled_from(VOCABULARY).flatmap(lambda w: st.sampled_from([w, "^" + w, "^" + w[:1]]))
_query = st.recursive(_word, lambda x: st.lists(x, min_size=2, max_size=3).flatmap(lambda p: st.sampled_from([" ".join(p), "(" + "|".join(p) + ")", "&".join(p)])), max_leaves=6)


@settings(max_examples=25, deadline=None)
@given(query=_query)
def test_boolean_queries(made, query):
    rows, _, index = made
    keywords = {}
    for i, k in rows:
        if i is not None:
            keywords.setdefault(i, []).extend(k or [])
    tree = parse(query)
    got = sorted(r.id for r in index.find(query).collect())
    assert got == sorted(i for i, k in keywords.items() if evaluate(tree, k))


def test_same_as_the_predicate(spark):
    p = catalog.paragraphs(spark, DATA, True)
    index = q_search.index_of(spark, DATA)
    for q in ("(the|der) & ^un", "^th | la de", "zzz", "^q (the | ^a)"):
        assert sorted(r.id for r in index.find(q).collect()) == sorted(r.id for r in p.where(matches(q)).select("id").collect())


def test_empty_query_finds_what_has_keywords(made):
    rows, _, index = made
    assert sorted(r.id for r in index.find("").collect()) == sorted({i for i, k in rows if i is not None and any(k or [])})


def test_plan_reads_pages_of_terms_without_shuffle_or_text(spark, made):
    index = made[2]
    plan = index.find("(a | ^ab) cab")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "StringStartsWith(term,ab)" in plan and "Python" not in plan
    whole = q_search.kw_prefix(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "split" not in whole and "text" not in whole.split("ReadSchema")[1].split("\n")[0]


def test_ids_are_stored_as_differences(spark, made):
    import glob

    import pyarrow.parquet as pq

    files = [f for f in glob.glob(f"{made[2].path.removeprefix('file:')}/postings/*.parquet")]
    encodings = [pq.ParquetFile(f).metadata.row_group(0).column(1).encodings for f in files if pq.ParquetFile(f).metadata.num_rows]
    assert encodings and all("DELTA_BINARY_PACKED" in e for e in encodings)
    for f in files:
        t = pq.read_table(f).to_pylist()
        assert t == sorted(t, key=lambda r: (r["term"].encode(), r["id"]))


def test_dictionary_is_in_order(made):
    rows, _, index = made
    terms = [(r.term, r.n) for r in index.terms().collect()]
    want = {}
    for i, k in rows:
        for w in set(k or []) - {None}:
            if i is not None:
                want.setdefault(w, set()).add(i)
    assert terms == sorted(((w, len(x)) for w, x in want.items()), key=lambda t: t[0].encode())
    assert [r.term for r in index.terms("ab").collect()] == ["ab", "abc", "abd"]


def test_strings_as_ids_and_empty_table(spark):
    df = spark.createDataFrame([("p1", ["x", "y"]), ("p2", ["x"])], "id string, keywords array<string>")
    assert [r.id for r in inverted.Index.build(df, folders.scratch(spark, "k")).find("x y").collect()] == ["p1"]
    assert inverted.Index.build(df.limit(0), folders.scratch(spark, "k")).find("x | ^y").count() == 0
