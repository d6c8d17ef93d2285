"""Periodic runs against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import awkward, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from lexifold.llm import periodic_runs, tandem


def plain_runs(words, min_length, min_exponent):
    """All periods upwards; a stretch that a smaller period has taken is not listed again."""
    out, seen, n = [], set(), len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and (j - i + q) >= 2 * q and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                if j - i + q >= max(min_length, min_exponent * q):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.sampled_from([(2, 2), (6, 4), (4, 2), (6, 3), (9, 5)]))
def test_runs_equal_brute_force(docs, bounds):
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    symbols = np.array([x for d in docs for x in d], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = list(zip(*(x.tolist() for x in tandem.runs(symbols, first, *bounds)))) if len(symbols) else []
    assert sorted(got) == sorted((i, *r) for i, d in enumerate(docs) for r in plain_runs(d, *bounds))


@pytest.mark.parametrize("word", ["aaaaaaaaaaaaaaaa", "abaababaabaababaababa", "abababababcabababab", "abcabcabcabcabcabc" * 3])
def test_known_words(word):
    symbols = np.frombuffer(word.encode(), np.uint8).astype(np.uint64)
    assert list(zip(*(x.tolist() for x in tandem.runs(symbols, np.array([0, len(word)]))[1:]))) == plain_runs(word, 2, 2)


def test_longest_extensions():
    rng = random.Random(3)
    text = np.array([rng.randrange(2) for _ in range(200)])
    s = tandem.Strings(text, np.zeros(200, np.int64))
    a = np.array([rng.randrange(200) for _ in range(500)])
    b = (a + np.array([rng.randrange(1, 200) for _ in range(500)])) % 200
    for x, y, f, g in zip(a.tolist(), b.tolist(), s.forward(a, b).tolist(), s.backward(a, b).tolist()):
        assert f == next(k for k in range(201) if max(x, y) + k >= 200 or text[x + k] != text[y + k])
        assert g == next(k for k in range(201) if min(x, y) - k < 0 or text[x - k] != text[y - k])
    lpf = s.previous_factors()
    assert lpf.tolist() == [max([0, *(next(k for k in range(201) if i + k >= 200 or text[i + k] != text[j + k]) for j in range(i))]) for i in range(200)]


def wanted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 6, 4)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def rows_to_try():
    rows = [r for r in awkward() if len(r[1] or "") < 30000]
    rng = random.Random(7)
    rows += [(1000 + i, " ".join(rng.choice("a b c dd éé".split()) for _ in range(rng.randrange(200)))) for i in range(150)]
    rows += [(2000 + i, "line of text here\n" * i + "tail") for i in range(12)]
    return rows


@pytest.mark.parametrize("clash", [(), ("runs", "collapsed", "given", "h", "best", "n_runs")])
def test_report_equals_brute_force(spark, clash):
    rows = rows_to_try()
    got = periodic_runs.report(frame(spark, rows, clash))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((wanted(*r) for r in rows), key=key)
    assert any(r.n_runs for r in got.collect())


def test_empty_table_and_columns(spark):
    assert periodic_runs.report(frame(spark, [])).count() == 0
    got = periodic_runs.find(frame(spark, [(1, "x y x y x y z"), (2, None)], ("collapsed",)))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "runs", "collapsed"]
    assert [(r.text, [tuple(x) for x in r.runs], r.collapsed) for r in got.orderBy("doc_id").collect()] == [("x y x y x y z", [(0, 6, 2)], "x y z"), (None, [], "")]


def test_a_very_long_text(spark):
    text = "one two three " * 60000
    (row,) = periodic_runs.find(frame(spark, [(1, text)]), 6, 4).collect()
    assert [tuple(x) for x in row.runs] == [(0, 180000, 3)] and row.collapsed == "one two three"
