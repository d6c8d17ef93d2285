"""The findings of round 4: whole results from plans that carry them to larger tables."""

import numpy as np
import pytest

from lexifold.operators import bayes, counts, grams, graph, learning, topics, vectors
from lexifold.plans import catalogue
from lexifold.plans.pipeline import Context, compile_pipeline

SCRIPTS = ["Привет мир", "漢字漢字 ab", "ひらがなで書く", "한국어 text", "the cat", "  ", "", None, "été là", "Привет the long cat", "\u00a0é", "🙂🙂"]


def plain_script(t):
    n = len([c for c in t if c not in " \t\n\x0b\f\r"])
    count = lambda a, b: sum(a <= ord(c) <= b for c in t)
    han, kana, cyrillic, hangul = count(0x4E00, 0x9FFF), count(0x3040, 0x30FF), count(0x400, 0x4FF), count(0xAC00, 0xD7AF)
    if not n:
        return None, None
    for lang, told, m in (("ko", hangul > 0, hangul), ("ja", kana > 0.3 * n, kana + han), ("zh", han > 0.5 * n, han), ("ru", cyrillic > 0.5 * n, cyrillic)):
        if told:
            return lang, m / n
    return None, None


def test_f1_language_counts_scripts_once(spark):
    df = spark.createDataFrame([(i, t, "auto") for i, t in enumerate(SCRIPTS)], "id long, content string, lang string")
    model = bayes.LANGUAGES.fit(spark.createDataFrame([("the cat sat", "en"), ("der Hund", "de")], "content string, label string"))
    out = compile_pipeline(df, [["PDFLanguageDetect", {}]], Context(named={"language_model": model}))
    assert out.columns == ["id", "content", "lang", "lang_confidence"]
    for r in out.collect():
        lang, share = plain_script(SCRIPTS[r.id] or "")
        assert r.content == SCRIPTS[r.id] and (lang is None or (r.lang, r.lang_confidence) == (lang, share))
        assert lang or r.lang in ("en", "de")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 6  # one for each script and one for white space


@pytest.mark.parametrize("kind", ["triples", "words"])
def test_f1_features_of_many_texts_at_once(kind):
    texts = ["ab", "", "abc", None, "a", "Über dem 日本 x", "x", "y z", "", "tail!", "🙂🙂🙂"]
    f, n = bayes._features(kind, 16, texts)
    one = [bayes._features(kind, 16, [t])[0] for t in texts]
    assert n.tolist() == [len(x) for x in one] and f.tolist() == np.concatenate(one).tolist()
    assert list(bayes._blocks(texts, 4)) == [(0, 3), (3, 6), (6, 8), (8, 10), (10, 11)]


ODD = ["the cat sat on the mat", "", None, "a", "été à 日本🙂🙂日本\u0000x", "  two  blanks ", "abcabcabc" * 50, "ab"]


@pytest.mark.parametrize("n", [1, 3, 4])
@pytest.mark.parametrize("piece", [1 << 20, 5])
def test_f3_grams_by_arrays_are_those_by_columns(spark, monkeypatch, n, piece):
    monkeypatch.setattr(grams, "PIECE", piece)
    monkeypatch.setattr(grams.blocks, "__defaults__", (piece,))
    df = spark.createDataFrame([(t,) for t in ODD], "content string")
    want = {(r.gram, r.n) for r in counts.ngrams(df, n).collect() if not r.gram.startswith(" ")}
    assert {(r.gram, r.n) for r in grams.ngrams(df, n).collect()} == want
    words = sorted({g for g, _ in want if "\u0000" not in g})[::2]
    kept = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.side, r.word, chr(r.char), r.n) for r in grams.neighbours(df, words).collect()}
    left, right = counts.ngram_neighbours(df, n, "content", kept)
    assert got == {("left", *r) for r in map(tuple, left.collect())} | {("right", *r) for r in map(tuple, right.collect())}
    assert grams.neighbours(df, []).count() == 0


def test_f3_many_letters_and_flushes(monkeypatch):
    rng = np.random.default_rng(3)
    codes = rng.integers(0x3400, 0xD000, 200_000).astype(np.uint32)  # more letters than 15 bits number
    monkeypatch.setattr(grams._Sums, "__init__", lambda self: self.__dict__.update(held=[], size=0, most=1000))
    text = codes.tobytes().decode("utf-32-le")
    seen = {}

    class Rows:
        sparkSession = None

        def select(self, *a):
            return self

        where = groupBy = agg = select

        def mapInArrow(self, f, schema):
            self.f = f
            return self

    monkeypatch.setattr(grams, "ship", lambda s: None)
    monkeypatch.setattr(grams.F, "col", lambda c: type("C", (), {"alias": lambda s, x: s})())
    monkeypatch.setattr(grams.F, "sum", grams.F.col)
    rows = grams.ngrams(Rows(), 4)
    batch = grams.pa.record_batch([grams.pa.array([text, text[:50]])], ["t"])
    for out in rows.f([batch]):
        for g, k in zip(*[c.to_pylist() for c in out.columns]):
            seen[g] = seen.get(g, 0) + k
    want = {}
    for t in (text, text[:50]):
        padded = "   " + t
        for p in range(3, len(padded)):
            for m in range(1, 5):
                g = padded[p - m + 1 : p + 1]
                if g[0] != " ":
                    want[g] = want.get(g, 0) + 1
    assert seen == want


def test_f3_words_are_counted_by_arrays(spark, tmp_path):
    df = spark.createDataFrame([("abcxabcyabcz" * 20,)], "content string")
    seen = []
    plain = grams.ngrams
    grams.ngrams = lambda *a: seen.append(a[1]) or plain(*a)
    try:
        got = counts.pmi_words(df, 3, 0.001, 0.5, 0.5).collect()
    finally:
        grams.ngrams = plain
    assert seen == [3] and "abc" in {r.word for r in got}


def groups(n, edges):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in {x for e in edges for x in e}}


@pytest.mark.parametrize("threshold", [0.2, 0.8, 1.1])
def test_f6_trees_join_what_pairs_join(spark, threshold):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    x[250:280] = x[7]
    x[290:] = 0
    near = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)
    edges = [(i, j) for i, j in zip(*np.nonzero(near @ near.T >= threshold)) if i < j]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5, [0.0] * 8), (300, None)], "id long, v array<double>").repartition(5)
    for size in (40 * 64, 1 << 20):
        tree = vectors.linked(df, threshold, size)
        assert {r.node: r.component for r in graph.components(tree).collect()} == groups(300, edges)


def test_f6_one_id_of_two_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    assert {(r.a, r.b) for r in vectors.linked(df, 0.9, 16).collect()} in ({(2, 3)}, {(3, 2)}, {(2, 3), (3, 2)})


def test_f6_components_get_no_list_of_pairs(spark, monkeypatch, tmp_path):
    seen, plain = [], graph.clusters
    monkeypatch.setattr(graph, "clusters", lambda edges, n: seen.append(edges.count()) or plain(edges, n))
    rows = [(i, [1.0, i / 1000], 1) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.node, r.cluster) for r in catalogue.queries()["cosine_components"](spark, str(tmp_path)).collect()}
    assert got == {(i, 0) for i in range(300)} and seen[0] <= 300 * 5  # of 44850 pairs


def test_f5_nearest_in_tiles_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x[100:180] = x[3]
    x[200] = 0
    plain = vectors._top
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)], "id long, v array<double>").repartition(3)
    q = df.where("id % 3 = 0").selectExpr("id AS query_id", "v")
    y = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)
    s = np.array([[(a * b).sum() for b in y] for a in y])
    want = {i: [(j, s[i, j]) for j in np.lexsort((np.arange(400), -s[i]))[:7]] for i in range(0, 400, 3)}
    for tile in ((2048, 2048, 1 << 17), (50, 7, 11), (3, 40, 1)):
        monkeypatch.setattr(vectors, "_top", lambda *a, tile=tile: plain(*a, *tile))
        for size in (64 << 20, 2000):
            got = {}
            for r in vectors.nearest(df, q, 7, size).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((r.id, r.cosine))
            assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
            assert all(abs(c - w) < 1e-12 for i in want for (_, c), (_, w) in zip(got[i], want[i]))


def test_f5_no_product_of_all_queries(spark, monkeypatch):
    """A task's memory: 12000 rows by 12000 queries would be 1152 MB."""
    import resource

    seen, plain = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: seen.append(x) or plain(x))

    class Rows:
        sparkSession = spark

        def select(self, *a):
            return self

        where = select

        def mapInArrow(self, f, schema):
            self.f = f
            return self

    x = np.random.default_rng(1).normal(size=(12000, 4))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    f = vectors._top(Rows(), np.arange(12000), x, 2).f
    pa = vectors.pa
    batch = pa.record_batch([pa.array(np.arange(12000)), pa.array(list(x))], ["id", "v"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = pa.Table.from_batches(list(f([batch])))
    assert out.num_rows == 24000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_f2_inference_of_documents():
    from math import pi

    assert abs(topics.digamma(1.0) + 0.5772156649015329) < 1e-12 and abs(topics.trigamma(1.0) - pi**2 / 6) < 1e-10
    assert abs(topics.digamma(0.5) + 1.9635100260214235) < 1e-12
    rng = np.random.default_rng(2)
    size = np.array([1, 30, 2, 7] * 10)
    w, c, alpha = rng.random((size.sum(), 3)) ** 4, rng.integers(1, 9, size.sum()).astype(float), np.array([0.3, 0.2, 0.5])
    gamma, added = topics.infer(w, c, size, alpha)
    for d, end in enumerate(np.cumsum(size)):
        mine, times, g = w[end - size[d] : end], c[end - size[d] : end], np.ones(3)
        while True:
            theta = np.exp(topics.expectation(g))
            new = theta * (mine * (times / (mine @ theta))[:, None]).sum(0) + alpha
            change, g = np.abs(new - g).mean(), new
            if change <= 1e-3:
                break
        theta = np.exp(topics.expectation(g))
        assert np.allclose(gamma[d], g) and np.allclose(added[end - size[d] : end], mine * theta * (times / (mine @ theta))[:, None])
        assert np.allclose(added[end - size[d] : end].sum(1), times)


def test_f2_topics_with_words_beyond_the_driver(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    rng = np.random.default_rng(4)
    rows = [(i, [f"w{x}" for x in (rng.integers(0, 60, 40) ** 2 // 40 + 100 * (i % 2))]) for i in range(60)] + [(60, []), (61, None), (62, ["w1", None, "only"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    monkeypatch.setattr(topics, "SHARE", 0.5)
    monkeypatch.setattr(topics, "PAIRS", 100)
    plain, found = topics.Topics, []
    for head in (0, 25, 1000):
        monkeypatch.setattr(topics, "Topics", lambda *a, head=head, **b: found.append(plain(*a, head, **b)) or found[-1])
        monkeypatch.setattr(learning, "LOCAL_WORDS", 10)
        monkeypatch.setattr(CountVectorizer, "fit", None)
        assigned, described = learning.topics(df, 3, words=4)
        seen = {r.id: r.topic for r in assigned.collect()}, {r.topic: r.terms for r in described.collect()}
        assert sorted(seen[0]) == list(range(63)) and seen[0][60] == seen[0][61] == 0 and all(len(v) == 4 for v in seen[1].values())
        found[-1] = (seen, found[-1].alpha, found[-1].all, len(found[-1].names))
    assert [f[3] < 26 for f in found] == [True, True, False] and found[0][3] == 0
    for f in found[1:]:  # where a word's weights are kept changes nothing
        assert f[0] == found[0][0] and np.allclose(f[1], found[0][1]) and np.allclose(f[2], found[0][2])


def test_f4_pairs_of_a_long_record_in_small_parts():
    from collections import Counter

    x = np.random.default_rng(9).integers(0, 5000, 20_000)
    parts = list(counts._pair_counts(x))
    assert max(len(n) for _, _, n in parts) <= 1 << 19  # before: 512 codes by all
    assert sum(int(n.sum()) for _, _, n in parts) == 20_000 * 19_999 // 2
    y = x[:700]
    want = Counter((a, b) for i, a in enumerate(y) for b in y[i + 1 :])
    for cells in (1, 1000, 1 << 19):
        assert {(a, b): n for p in counts._pair_counts(y, 64, cells) for a, b, n in zip(*p)} == want


def test_f4_codes_without_a_pair_within_a_block():
    """The 513th code stands only at a block's end: before, numpy refused to add its products."""
    x = np.concatenate((np.arange(255), [512], np.arange(255, 511), [511], np.arange(20)))
    from collections import Counter

    want = Counter((int(a), int(b)) for i, a in enumerate(x) for b in x[i + 1 :])
    assert {(int(a), int(b)): int(n) for p in counts._pair_counts(x) for a, b, n in zip(*p)} == want
