"""Naive Bayes against plain counts, and the stages that use it and the dictionaries."""

import math
import re
from collections import Counter

import pytest

from lexifold import catalog
from lexifold.operators import bayes, segment
from lexifold.plans import stages  # noqa: F401
from lexifold.plans.pipeline import Context, compile_pipeline

TEXTS = [("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("Le chat est là, été", "fr"), ("THE dog", "en"), (None, "en"), ("", "de"), ("ab", "fr"), ("no label", None), ("die die die", "de"), ("日本語のテキスト🙂x", "ja")]


def plain(kind, bits, text):
    if kind == "triples":
        c = [ord(x) for x in text]
        return [(a * 961 + b * 31 + d) % 2**bits for a, b, d in zip(c, c[1:], c[2:])]
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    out = []
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low):
        h = 0
        for x in w:
            h = (h * 31 + ord(x)) % 2**bits
        out.append(h)
    return out


@pytest.mark.parametrize("model", [bayes.LANGUAGES, bayes.SENTIMENT, bayes.Bayes("words", 3)])
def test_counts_and_scores(spark, model):
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(TEXTS)], "id long, content string, label string")
    fitted = model.fit(df)
    want = Counter((x, f) for t, x in TEXTS if t is not None and x is not None for f in plain(model.kind, model.bits, t))
    assert {(r.label, r.feature): r.n for r in fitted.collect()} == want
    labels = sorted({x for x, _ in want})
    total = {x: sum(n for (y, _), n in want.items() if y == x) for x in labels}
    got = {r.id: (r.guess, r.confidence) for r in model.score(df, fitted).collect()}
    for i, (t, _) in enumerate(TEXTS):
        f = plain(model.kind, model.bits, t or "")
        if not f:
            assert got[i] == (None, None)
            continue
        s = {x: sum(bayes.log_probability(want[x, k], total[x], model.bits) for k in f) for x in labels}
        best = max(labels, key=lambda x: (s[x], -labels.index(x)))
        assert got[i][0] == best and abs(got[i][1] - 1 / sum(math.exp(max(s[x] - s[best], -700)) for x in labels)) < 1e-9


def test_languages_of_rows_kept_aside(spark):
    folder = "/root/testdata/sf0.01"
    p = catalog.paragraphs(spark, folder)
    model = bayes.LANGUAGES.fit(p.where("id % 4 <> 2"), "content", "lang")
    kept = bayes.LANGUAGES.score(p.where("id % 4 = 2 AND length(content) > 40"), model).select("lang", "guess").collect()
    assert len(kept) > 200 and sum(r.lang == r.guess for r in kept) / len(kept) > 0.97


def run(df, *steps, **named):
    return compile_pipeline(df, [list(s) for s in steps], Context(named=named))


def test_detection_by_script_and_model(spark):
    rows = [(1, "Привет мир", "auto"), (2, "漢字漢字", ""), (3, "ひらがなで書く", None), (4, "한국어 text", "auto"), (5, "the cat", "auto"), (6, "der Hund", "auto"), (7, "der Hund", "xx"), (8, None, "auto"), (9, "", None)]
    df = spark.createDataFrame(rows, "id long, content string, lang string")
    fitted = bayes.LANGUAGES.fit(spark.createDataFrame(TEXTS[:2], "content string, label string"))
    got = {r.id: r.lang for r in run(df, ("LanguageDetect", {}), language_model=fitted).collect()}
    assert got == {1: "ru", 2: "zh", 3: "ja", 4: "ko", 5: "en", 6: "de", 7: "xx", 8: "en", 9: "en"}
    shares = {r.id: r.lang_confidence for r in run(df, ("PDFLanguageDetect", {}), language_model=fitted).collect()}
    assert shares[1] == shares[2] == 1.0 and abs(shares[4] - 3 / 7) < 1e-9 and 0.5 < shares[5] < 1 and shares[8] == shares[9] == 0.5


def test_sentiment(spark):
    rows = [("good fine good", "positive"), ("bad awful", "negative")]
    fitted = bayes.SENTIMENT.fit(spark.createDataFrame(rows, "content string, label string"))
    df = spark.createDataFrame([(1, "good"), (2, "awful bad"), (3, ""), (4, None), (5, "unknown")], "id long, content string")
    got = {r.id: r.sentiment for r in run(df, ("AutoSentimentAnalysis", {}), sentiment_model=fitted).collect()}
    assert got[1] > 0 > got[2] and got[3] == got[4] == 0 and abs(got[5]) < 1e-4 and all(-1 <= x <= 1 for x in got.values())


def test_chinese_stages(spark):
    df = spark.createDataFrame([(1, "學習漢語", "zht"), (2, None, "en"), (3, "研究生命起源。", "zh"), (4, "Plain words", "en")], "id long, content string, lang string")
    simple = {r.id: (r.content, r.lang) for r in run(df, ("TradToSimpChinese", {})).collect()}
    assert simple[1] == ("学习漢語", "zhs") and simple[2] == (None, "en")
    longer = spark.createDataFrame([("學習", "学习"), ("學", "X"), ("漢語", "汉语")], "phrase string, value string")
    assert run(df, ("TradToSimpChinese", {}), traditional=longer).where("id = 1").first().content == "学习汉语"
    parts = {r.id: r.chaizi for r in run(df, ("HanziChaizi", {"table": {"語": "言吾", "漢": "氵堇"}})).collect()}
    assert parts == {1: ["氵堇", "言吾"], 2: [], 3: [], 4: []}
    fitted = segment.fit(df, ["研究", "研究生", "生命", "命", "起源"])
    cut = {r.id: r.keywords for r in run(df, ("WordCut", {}), segmentation=fitted).collect()}
    assert cut[3] == ["研究", "生命", "起源"] and cut[4] == ["plain", "words"] and cut[2] == []
    assert run(df, ("WordCut", {})).where("id = 1").first().keywords == ["學", "習", "漢", "語", "學習", "習漢", "漢語"]
    names = run(df, ("GazetteerNER", {"table": {"研究": "T", "words": "W"}}), ("NERAsTokens", {})).collect()
    assert {r.id: r.tokens for r in names} == {1: [], 2: None, 3: ["研究/T"], 4: ["words/W"]}


def test_sources_of_records(spark):
    df = spark.createDataFrame([(1, "a|b||c", "de"), (2, None, None), (3, "d", "fr")], "id long, content string, lang string")
    got = run(df, ("LinesDataSource", {"delimiter": "|", "dataset_name": "set", "lang": "auto"})).collect()
    assert sorted((r.id, r.pos, r.content, r.lang, r.dataset_name) for r in got) == [(1, 0, "a", "de", "set"), (1, 1, "b", "de", "set"), (1, 3, "c", "de", "set"), (3, 0, "d", "fr", "set")]
    js = spark.createDataFrame([('{"results": [{"a": 1}, {"a": 2}]}',), ("[3]",), ("no json",)], "content string")
    assert run(js, ("JSONDataSource", {})).count() == 3
