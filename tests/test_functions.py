"""Column functions on inline rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexifold.functions import arrays, chunks, dates, geo, stems, text, transliterate, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


def loop_starts(n, length, overlap):
    """Windows one after the other, as the definition has it."""
    if n <= 0 or length <= 0 or overlap < 0 or overlap >= length:
        return []
    out, at = [], 0
    while True:
        out.append(at)
        if at + length > n - (length - overlap) and at + length >= n - (length - overlap) and at + (length - overlap) + length > n:
            break
        at += length - overlap
    if at + (length - overlap) < n:
        out.append(max(0, n - length))
    return out


@pytest.mark.parametrize("n,k", [(0, 0), (1, 1), (149, 1), (150, 1), (151, 2), (160, 2), (200, 2), (201, 2), (350, 3), (351, 3)])
def test_chunk_counts(spark, n, k):
    assert len(one(spark, chunks.chunk_starts(F.lit(n), 200, 50))) == k


@settings(max_examples=25, deadline=None)
@given(n=st.integers(0, 90), length=st.integers(1, 25), overlap=st.integers(-1, 26))
def test_chunk_starts(spark, n, length, overlap):
    got = one(spark, chunks.chunk_starts(F.lit(n), length, overlap))
    assert got == loop_starts(n, length, overlap)
    if got:
        covered = {i for s in got for i in range(s, min(n, s + length))}
        assert covered == set(range(n))


@pytest.mark.parametrize("spec,pages", [("1-3", [0, 1, 2]), ("1,3,5-6", [0, 2, 4, 5]), ("x-2", []), ("", []), ("0", []), ("12", [11]), ("3-1", []), (None, [])])
def test_page_range(spark, spec, pages):
    assert one(spark, arrays.page_range(F.lit(spec).cast("string"))) == pages


def test_arrays(spark):
    a = F.array(*[F.lit(x) for x in "abab"])
    assert one(spark, arrays.remove_first(a, F.lit("b"))) == ["a", "a", "b"]
    assert one(spark, arrays.remove_first(a, F.lit("z"))) == list("abab")
    assert one(spark, arrays.replace_keyword(a, "a", "c")) == ["b", "a", "b", "c"]
    null = F.lit(None).cast("array<string>")
    assert one(spark, arrays.has(null, "a")) is False and one(spark, arrays.has(F.array(F.lit(None).cast("string")), "a")) is False
    assert one(spark, arrays.push(null, "x")) == ["x"]


@pytest.mark.parametrize("given_,want", [
    ("ﬁn eﬃcient", "fin efficient"), ("exam-\nple", "example"), ("‘a’ “b”", "'a' \"b\""), ("a\n\n\n\nb", "a\n\nb"), ("a  \t b \n c", "a b\nc"), ("a—b…", "a-b..."), (" x ", "x"), ("a​b﻿", "ab"),
])
def test_clean_text(spark, given_, want):
    assert one(spark, text.clean_text(F.lit(given_))) == want


@pytest.mark.parametrize("given_,want", [
    ("short@@@@", False), ("abcdefghij", False), ("ab@#@#$%^&*cdefgh", True), ("aBcDeFgHiJkLmNoP", True), ("plain words and � here", True), ("", False), (None, False), ("Überfällige Größe für Müßiggänger", False),
])
def test_garbled(spark, given_, want):
    assert one(spark, text.is_garbled(F.lit(given_).cast("string"))) is want


@pytest.mark.parametrize("given_,want", [("漢字漢字", "zh"), ("ひらがな漢字", "ja"), ("한국어 x", "ko"), ("Привет", "ru"), ("12 34", None), ("ab", None), ("", None), ("ab漢", None)])
def test_script(spark, given_, want):
    assert one(spark, text.script_language(F.lit(given_))) == want


@pytest.mark.parametrize("given_,want", [("der die und nicht", "de"), ("le la les des", "fr"), ("the of and", "en"), ("el los y que", "es"), ("xyz", "en")])
def test_language(spark, given_, want):
    assert one(spark, text.detect_language(F.lit(given_))) == want


@pytest.mark.parametrize("given_,want", [
    ("am 2024年1月5日", "2024-01-05 00:00:00"), ("2024-1-5", "2024-01-05 00:00:00"), ("2024/01/05 3:04", "2024-01-05 03:04:00"), ("24-1-5", "2024-01-05 00:00:00"), ("1月5日", "2024-01-05 00:00:00"),
    ("3点4分5秒", "2024-06-15 03:04:05"), ("3天前", "2024-06-12 12:00:00"), ("10分钟前", "2024-06-15 11:50:00"), ("none", None), ("2024-13-45", None),
])
def test_dates(spark, given_, want):
    got = one(spark, dates.extract_time(F.lit(given_)))
    assert (str(got) if got else None) == want


def test_partial_dates(spark):
    got = [one(spark, dates.partial_date(F.lit(x))) for x in ("2020", "2020-3", "2020-03-09", "spring")]
    assert [str(g)[:10] if g else None for g in got] == ["2020-01-01", "2020-03-01", "2020-03-09", None]


def test_words(spark):
    assert one(spark, text.tokens(F.lit("Été, l'eau_1!"))) == ["été", "l", "eau_1", "ete", "l", "eau_1"]
    assert one(spark, text.keywords_of(F.lit(None).cast("string"))) == []
    assert one(spark, text.filter_punctuation(F.lit('"Hi, (you) there."'))) == "Hiyouthere"
    assert one(spark, stems.stem(F.array(F.lit("walking")), F.lit("en"))[0]) == "walk"
    assert one(spark, transliterate.to_latin(F.lit("Жизнь"))) == "zhizn"


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0))) == 1
    assert one(spark, vectors.cosine(v(1, 0), v(0, 1))) == 0
    assert one(spark, vectors.cosine(v(1, 0), v(-1, 0))) == -1
    assert one(spark, vectors.cosine(v(0, 0), v(1, 0))) is None


def test_geo(spark):
    lat, lng = geo.gcj_to_wgs(F.lit(39.915), F.lit(116.404))
    assert one(spark, lat) == pytest.approx(39.9136, abs=1e-3) and one(spark, lng) == pytest.approx(116.3978, abs=1e-3)
