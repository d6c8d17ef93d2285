"""The keyword language and the expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexifold.plans import keywords as K
from lexifold.plans.expressions import compile_condition, compile_value

ROWS = [(0, ["a", "ab", "b"]), (1, ["abc"]), (2, []), (3, None), (4, [None, "b"]), (5, [None])]
WORDS = st.sampled_from(["a", "b", "ab", "^a", "^ab", "zz", "A"])
QUERIES = st.recursive(
    WORDS, lambda q: st.one_of(st.tuples(q, q).map(" & ".join), st.tuples(q, q).map(" ".join), st.tuples(q, q).map("|".join), q.map("({})".format)), max_leaves=6
)


@pytest.mark.parametrize("query,tree", [
    ("a b", K.And((K.Word("a"), K.Word("b")))), ("a&b", K.And((K.Word("a"), K.Word("b")))), ("a|b", K.Or((K.Word("a"), K.Word("b")))),
    ("(a|b) c", K.And((K.Or((K.Word("a"), K.Word("b"))), K.Word("c")))), ("^ab", K.Word("ab", True)), ("A", K.Word("a")), ("", None), ("  ", None),
])
def test_parse(query, tree):
    assert K.parse(query) == tree


@pytest.mark.parametrize("query", ["(a", "a|", "|a", "a)", "a & | b", "()"])
def test_parse_errors(query):
    with pytest.raises(ValueError):
        K.parse(query)


@settings(max_examples=25, deadline=None)
@given(query=QUERIES)
def test_compiled_equals_evaluated(spark, query):
    df = spark.createDataFrame(ROWS, "id int, keywords array<string>")
    got = {r[0]: r[1] for r in df.select("id", K.matches(query)).collect()}
    assert got == {i: K.evaluate(K.parse(query), k) for i, k in ROWS}


def _value(spark, text, row="1 AS n, 'Ab' AS s, array('x','y') AS t, map('k','v') AS extdata, cast(null as string) AS z"):
    df = spark.sql(f"SELECT {row}")
    return df.select(compile_value(df, text).alias("v")).first().v


@pytest.mark.parametrize("text,want", [
    ("n + 1", 2), ("s + 'c'", "Abc"), ("unknown", "unknown"), ("$n * 3", 3), ("len(t)", 2), ("lower(s)", "ab"), ("s.upper()", "AB"), ("'x' in t", True),
    ("'q' in t", False), ("t[1]", "y"), ("t[9]", None), ("s[0]", "A"), ("s[0:1]", "A"), ("extdata['k']", "v"), ("$k", "v"), ("z == None", True), ("n if n > 0 else 5", 1),
    ("7 // 2", 3), ("-n", -1), ("not n", False), ("t + ['z']", ["x", "y", "z"]), ("1 < n + 1 < 3", True), ("int('12')", 12), ("int('q')", None), ("s.startswith('A')", True),
])
def test_values(spark, text, want):
    assert _value(spark, text) == want


@pytest.mark.parametrize("text", ["__import__('os')", "(lambda: 1)()", "[x for x in t]", "s.__class__", "open('x')", "n := 1"])
def test_refused(spark, text):
    with pytest.raises((ValueError, SyntaxError)):
        _value(spark, text)


@pytest.mark.parametrize("text,want", [("z", False), ("z or n", True), ("''", False), ("0", False), ("t", True), ("null > 3", False), ("s != 'Ab'", False)])
def test_conditions(spark, text, want):
    df = spark.sql("SELECT 1 AS n, 'Ab' AS s, array('x') AS t, cast(null as string) AS z")
    assert df.select(compile_condition(df, text).alias("v")).first().v is want


def test_predicate_refuses_queries(spark):
    from lexifold.plans.search import predicate

    with pytest.raises(ValueError):
        predicate("id in (select id from x)")


def test_search_edges(spark):
    from lexifold.plans.search import Filters, Tables, count, search

    p = spark.createDataFrame([("1", "f1", 0, "x", ["a"]), ("2", "f1", 1, None, None), ("3", None, 2, "50% off", ["ab"])], "id string, source string, source_page int, content string, keywords array<string>")
    bridge = spark.createDataFrame([("a", "f1"), ("a--b", "f1"), ("ab--x", "f9")], "dataset string, file_id string")
    t = Tables(p, spark.createDataFrame([("f1", "corpus/x")], "id string, path string"), bridge)
    ids = lambda **f: sorted(r.id for r in search(t, Filters(**f)).collect())
    assert ids() == ["1", "2", "3"]
    assert ids(datasets=("a",)) == ["1", "2"]  # once each, though the file is in two data sets
    assert ids(datasets=("ab",)) == []
    assert ids(source_page=0) == ["1", "2", "3"]
    assert ids(q="*% off*") == ["3"]
    assert ids(q="?content is null") == ["2"]
    assert ids(sources=("CORPUS/",)) == ["1", "2"]
    assert count(t, Filters(q="^a", limit=1)).first().n == 2
    assert [r.id for r in search(t, Filters(sort="-content", limit=2)).collect()] == ["2", "1"]
    assert F is not None


def test_terms_rights_and_history(spark):
    from lexifold.plans.search import Filters, history, terms_with_prefix, visible

    t = spark.createDataFrame([("abc",), ("abd",), ("b",)], "term string")
    assert [r.term for r in terms_with_prefix(t, "AB").collect()] == ["abc", "abd"]
    r = spark.createDataFrame([("u", None), ("v", True), ("w", False)], "creator string, shared boolean")
    assert visible(r, "u").count() == 2 and visible(r, "u", admin=True).count() == 3
    assert '"q": "a & b"' in history(spark, "u", Filters(q="a & b")).first().queries
