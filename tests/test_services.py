"""Text to vector in search, translation in pieces, named recognisers, large text files."""

import json

import pytest
from pyspark.sql import functions as F

from lexifold.plans import search, stages  # noqa: F401
from lexifold.plans.pipeline import Context, compile_pipeline
from lexifold.sources import readers


def run(df, *steps, named=None, **constants):
    return compile_pipeline(df, [list(s) for s in steps], Context(named=named or {}, constants=constants))


def test_query_encoder_remembers():
    asked, now = [], [0.0]

    def encode(texts):
        asked.extend(texts)
        return [[len(t), 1] for t in texts]

    e = search.QueryEncoder(encode, ttl=10, most=2, clock=lambda: now[0])
    assert e("ab") == (2.0, 1.0) and e("ab") == (2.0, 1.0) and asked == ["ab"]
    now[0] = 9
    e("ab")
    now[0] = 18  # the last use renewed it
    e("ab")
    assert asked == ["ab"]
    now[0] = 40
    e("ab")
    assert asked == ["ab", "ab"]
    e("b"), e("c"), e("b"), e("ab")
    assert asked == ["ab", "ab", "b", "c", "ab"]


def test_search_by_text(spark):
    p = spark.createDataFrame([(1, "s1", "x"), (1, "s2", "y"), (2, "s1", "z")], "id long, source string, content string")
    e = spark.createDataFrame([(1, "s1", 0, [1.0, 0.0]), (1, "s2", 0, [0.0, 1.0]), (1, "s2", 1, [0.6, 0.8]), (2, "s1", 0, [1.0, 1.0]), (9, "s1", 0, [1.0, 0.0])], "id long, source string, chunk_id int, embedding array<double>")
    t = search.Tables(p, embeddings=e, encoder=lambda text: (1.0, 0.0) if text == "east" else (0.0, 1.0))
    got = [(r.id, r.source, round(r.distance, 6)) for r in search.search(t, search.Filters(q=": east")).collect()]
    assert got == [(1, "s1", 0.0), (2, "s1", round(1 - 0.5**0.5, 6)), (1, "s2", 0.4)]
    assert search.search(t, search.Filters(q=":north", limit=1)).first().source == "s2"
    with pytest.raises(ValueError):
        search.search(search.Tables(p, embeddings=e), search.Filters(q=":east"))


def service(most=10**9):
    """Made here so that it travels by value."""

    def upper(requests):
        bodies = [json.loads(r) for r in requests]
        if any("boom" in str(b) for b in bodies):
            raise OSError("no service")
        texts = [b.get("text") or b.get("q") for b in bodies]
        assert all(len(t) <= most for t in texts)
        return [t.upper() for t in texts]

    return upper


@pytest.mark.parametrize("name,most", [("RemoteTranslation", 5000), ("BaiduTranslation", 2000), ("YoudaoTranslation", 5000), ("GoogleTranslation", 5000)])
def test_translation_in_pieces(spark, name, most):
    long = "a sentence of some length. " * 900
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "")], "id long, content string").coalesce(1)
    got = {r.id: r.content for r in run(df, (name, {"to_lang": "de"}), **{f"transport:{name}": service(most)}).collect()}
    assert got[1].replace(" ", "") == long.upper().replace(" ", "") and got[2] == "SHORT" and got[4] == "" and 3 not in got
    failing = spark.createDataFrame([(1, "boom"), (2, "fine")], "id long, content string").repartition(2, "id")
    assert 1 not in {r.id for r in run(failing, (name, {}), **{f"transport:{name}": service()}).collect()}


def test_chinese_answers_come_in_the_script_asked_for(spark):
    df = spark.createDataFrame([(1, "x")], "id long, content string")
    say = lambda text: lambda requests: [text] * len(requests)
    assert run(df, ("RemoteTranslation", {"to_lang": "zhs"}), **{"transport:RemoteTranslation": say("學習")}).first().content == "学习"
    assert run(df, ("RemoteTranslation", {"to_lang": "zht"}), **{"transport:RemoteTranslation": say("学习")}).first().content == "學習"


def test_named_recognisers(spark):
    df = spark.createDataFrame([(1, "Ada met Bob")], "id long, content string")
    words = spark.createDataFrame([("Ada", "PERSON"), ("Bob", "PERSON")], "phrase string, value string")
    for name in ("HanLPModel", "HanlpNerZh", "HanlpNerJa", "SpaCyNER"):
        assert [tuple(x) for x in run(df, (name, {}), named={"gazetteer": words}).first().ner] == [("Ada", "PERSON"), ("Bob", "PERSON")]
    got = run(df, ("SpaCyNER", {}), **{"transport:SpaCyNER": lambda texts: [[{"text": "met", "label": "VERB"}] for _ in texts]}).first().ner
    assert [tuple(x) for x in got] == [("met", "VERB")]


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 70) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_bytes("\r\n".join(lines[:100]).encode())
    (tmp_path / "empty.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = readers.text_lines(spark, str(tmp_path / "*.txt"), "set", "en")
        assert got.select(F.spark_partition_id()).distinct().count() >= 1
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {}
    for r in rows:
        by.setdefault(r.source.rsplit("/", 1)[1], []).append((r.outline, r.content))
    assert sorted(by["a.txt"]) == [(f"{i + 1:06d}", x) for i, x in enumerate(lines)]
    assert sorted(by["b.txt"]) == [(f"{i + 1:06d}", x) for i, x in enumerate(lines[:100])] and "empty.txt" not in by


def test_pages_to_paragraphs_in_one_source(spark):
    def extract(data):
        return [(i, None, t) for i, t in enumerate(data.decode().split("|"))]

    texts = b"A first page that goes on with a hy-\nphenated word and some more\n1|2\nwhich ends on the second page.\nA second paragraph, long enough to stay, is here.|##$$%%^^&&**"
    df = spark.createDataFrame([("a.pdf", bytearray(texts))], "path string, content binary")
    got = run(df, ("PDFDataSource", {"clean": True, "reparagraph": True, "dataset_name": "set", "min_paragraph_length": 40}), **{"transport:PDFDataSource": extract}).collect()
    assert sorted((r.source_page, r.content) for r in got) == [(0, "A first page that goes on with a hyphenated word and some more which ends on the second page."), (1, "A second paragraph, long enough to stay, is here.")]
    assert {(r.lang, r.dataset_name, r.source) for r in got} == {("en", "set", "a.pdf")}
    plain = run(df, ("PDFDataSource", {"lang": "de", "page_range": "2"}), **{"transport:PDFDataSource": extract}).collect()
    assert [(r.source_page, r.lang) for r in plain] == [(1, "de")]
