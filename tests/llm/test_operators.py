"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import sys, os

sys.path.insert(0, os.path.dirname(__file__))
from helpers import awkward, frame, sentence  # noqa: E402

from lexifold.llm import chat, decontaminate, fmindex, mtree, ngram_join, packing, pii, quality, repair, shared, suffix_array, suffix_dedup, token_output, tokens, toxicity  # noqa: E402
from lexifold.llm import textblocks as tb  # noqa: E402

ROWS = awkward()


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# kernels


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), min_size=1, max_size=12))
def test_words_equal_regex(texts):
    for block in tb.blocks(pa.array(texts, pa.string()), max_bytes=64):
        for kind, pattern in ((tb.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (tb.WORD, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
            starts, ends, h, first = tb.words(block, kind)
            for i in range(len(block)):
                t = texts[block.rows.start + i] or ""
                own = slice(first[i], first[i + 1])
                got = [block.buf[a:b].tobytes().decode() for a, b in zip(starts[own], ends[own])]
                assert got == re.findall(pattern, t)
                low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in got]
                assert [tb.word_hash(w) for w in low] == h[own].tolist()


def test_append_columns_keeps_clashing_names(spark):
    df = frame(spark, [(1, "a b")], clash=("score", "predicted", "other"))
    model = quality.QualityModel(np.zeros(1 << quality.BITS, np.float32), 0.0)
    got = quality.score(df, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "other", "score", "predicted"] and got.first().score == 0.5


# 1 and 9: classifiers


def _labelled(spark, n=600):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        t = sentence(rng, 40)
        if bad:
            t = t.replace("river", "you idiot").replace("stone", "m0ron") + " you idiot!!"
        docs.append((i, t))
        labels.append((i, int(not bad), int(bad)))
    return frame(spark, docs), spark.createDataFrame(labels + [(None, 1, 0), (5, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_learn(spark, module, label):
    docs, labels = _labelled(spark)
    got = module.scored(docs, labels).join(labels.where(f"{label} is not null"), "doc_id").collect()
    assert len(got) == 599 or len(got) == 600
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r[label] for r in held) >= 0.97 * len(held)
    again = {r.doc_id: r.score for r in module.scored(docs.orderBy(F.rand(3)).repartition(3), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_take_anything(spark, module):
    docs, labels = _labelled(spark, 120)
    model = module.fit(docs, labels)
    odd = frame(spark, ROWS)
    got = module.score(odd.select("doc_id", "text"), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text or ""].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert module.score(odd.limit(0), model).count() == 0
    assert module.scored(odd, labels.limit(0)).count() == len(ROWS)  # nothing to learn from


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = _labelled(spark, 300)
    from lexifold.llm.labelled import held_out

    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.scored(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_isotonic():
    knots, values = toxicity.isotonic(np.array([0.0, 1, 2, 3, 3, 4]), np.array([0, 1, 0, 1, 0, 1.0]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()


# 2: PII

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    return {"email": True, "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def _base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS for m in re.finditer(p, text or "") if _valid(k, m[0])]


def test_pii_base_spans_equal_plain_patterns(spark):
    rng = random.Random(2)
    bits = ["a.b@c.de", "x@y", "@", "a@b.c@d.e", "a@b-c.d_e@f.g", "%%%", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "0000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "1 2 3", "+1 (743) 555-3824", "+1", "+12345678", "++44 20 7946 0000.", " ", "\n", "é", "😀", ".", "9", "word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [t for _, t in ROWS] + ["1 " * 3000, "%" * 5000, "7" * 3000, "a@b.c " * 300]
    got = {r.doc_id: r for r in pii.report(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = _base(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k, _ in PATTERNS]
        assert r.spans.startswith(",".join(want))


def test_pii_terms_that_disclose(spark):
    rng = random.Random(3)
    docs = []
    for i in range(60):
        t = sentence(rng, 30)
        if i % 6 == 0:
            t += f" ask Zebulon {sentence(rng, 3)} at zeb@corp.example.com of {sentence(rng, 5)}"
        if i % 6 == 1:
            t += f" ask {sentence(rng, 3)} at other{i}@corp.example.com"
        docs.append((i, t))
    docs += [(100 + i, docs[1][1].replace("other1@", "copy@")) for i in range(8)]  # copies of one context are no evidence
    df = frame(spark, docs + [(500, None)], clash=("spans", "rid"))
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert all((r.n_term == 1) == (i is not None and i < 60 and i % 6 == 0) for i, r in got.items())
    text = docs[0][1]
    at = text.index("Zebulon")
    assert f"term:{at}:{at + 7}" in got[0].spans
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[0].text == text.replace("Zebulon", "").replace("zeb@corp.example.com", "[EMAIL]") and clean[0].n_chars == len(clean[0].text)
    assert clean[2].text == docs[2][1] and clean[500].text is None and clean[0].spans == "mine" and clean[0].rid == "mine"
    assert pii.sanitise(df.limit(0)).count() == 0


def test_pii_terms_far_from_a_mention(spark):
    rng = random.Random(8)
    docs = [(i, sentence(rng, 60)) for i in range(200)]
    for i in range(8):  # a short name, a user name and a staff number, some 300 characters from the mention and twice in the text
        docs[i] = (i, f"Li {sentence(rng, 60)} Li zz_9 4711 {sentence(rng, 60)} li@corp.example.com")
    docs[50] = (50, f"{sentence(rng, 60)} zz_9 again")  # without a mention
    got = {r.doc_id: r for r in pii.report(frame(spark, docs)).collect()}
    for i, text in docs:
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\b(Li|zz_9|4711)\b", text)]
        assert [x for x in got[i].spans.split(",") if x.startswith("term")] == want
    assert got[0].n_term == 4 and got[50].n_term == 1


def test_pii_copies_do_not_hide_a_term(spark):
    rng = random.Random(12)
    docs = [(i, sentence(rng, 30)) for i in range(600)]
    docs += [(1000 + i, f"{sentence(rng, 5)} Zebulon zeb@corp.example.com {sentence(rng, 5)}") for i in range(3)]
    docs += [(2000 + i, "Zebulon of old zeb@corp.example.com hums") for i in range(300)]
    got = {r.doc_id: r.spans for r in pii.report(frame(spark, docs)).collect()}
    for i, text in docs:
        at = text.find("Zebulon")
        assert (f"term:{at}:{at + 7}" in got[i]) == (at >= 0)


def test_pii_overlapping_spans_become_one(spark):
    t = "call +4111 1111 1111 1111 or 10.0.0.1@x.yz now"
    r = pii.sanitise(frame(spark, [(1, t)])).first()
    assert "1111" not in r.text and "10.0.0.1" not in r.text and r.text.endswith(" now") and r.text.startswith("call ")


def test_pii_secrets(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'x = "{key}" é', f"😀 {key}{key}", "a_long_identifier_without_digits", "12345678901234567890", "aaaaaaaaaaaaaaaaa111111", f"{key[:19]}", f"{key}@corp.example.com"]
    got = {r.doc_id: r for r in pii.report(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i].n_secret for i in range(7)] == [1, 1, 0, 0, 0, 0, 1]
    assert got[0].spans == "secret:5:45" and got[1].spans == "secret:2:82" and got[6].spans == "email:0:57,secret:0:40"
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, list(enumerate(texts)))).collect()}
    assert clean[0] == 'x = "[SECRET]" é' and clean[2] == texts[2] and clean[6] == "[SECRET]"


def test_pii_many_spans_in_one_text(spark):
    """20 000 addresses, and as many words of a disclosing term, in one text."""
    import time

    many = " ".join(f"user{i}@corp.example.com" for i in range(20000))
    text = "é " + many + " Zebulon" * 5000 + " tail"
    docs = [(i, f"Zebulon zeb@corp.example.com {i}") for i in range(5)] + [(10, text + " zeb@corp.example.com")] + [(20 + i, f"none {i}") for i in range(300)]
    begin = time.time()
    got = {r.doc_id: r for r in pii.report(frame(spark, docs)).collect()}
    assert got[10].n_email == 20001 and got[10].n_term >= 5000
    assert got[10].spans.startswith(",".join(_base(docs[5][1])) + ",")
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, docs)).collect()}
    assert clean[10].startswith("é [EMAIL] [EMAIL] ") and clean[10].count("[EMAIL]") == 20001 and "Zebulon" not in clean[10]
    assert time.time() - begin < 120


def test_pii_moves_are_exact(spark):
    """Terms are cut as if all spans were blanks, however spans overlap."""
    rng = random.Random(4)
    bits = ["a.b@c.de", "x@", "1.2.3.4", "4111 1111 1111 1111", "+41 11 1111 1111 1111", "+12345678", ".", "-", " ", "é", "99", "aZ_9", "24be64439e3e49cf46b2d7c90f3602a3"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = frame(spark, list(enumerate(texts)))
    plain = {r.doc_id: r.p for r in df.select("doc_id", pii._plain(F.col("text")).alias("p")).collect()}
    spans = {r.doc_id: r.spans for r in pii._found(df).select("doc_id", "spans").collect()}
    for i, t in enumerate(texts):
        covered = {k for s in spans[i] for k in range(s.start, s.end)}
        assert [ord(c) >= pii.AWAY for c in plain[i]] == [k in covered for k in range(len(t))], t


def test_pii_shuffled_lookups(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, f"{sentence(rng, 20)} Zebulon zeb@corp.example.com" if i % 9 == 0 else sentence(rng, 20)) for i in range(90)] * 2 + [(200 + i, "same Zebulon text zeb@corp.example.com") for i in range(20)]
    df = frame(spark, docs)
    few = sorted(rows(pii.report(df), "doc_id", "spans"))
    monkeypatch.setattr(pii, "FEW", 0)
    assert sorted(rows(pii.report(df), "doc_id", "spans")) == few and any("term" in x for _, x in few)


def test_pii_plan_is_native(spark):
    plan = pii.report(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 3: suffix-array dedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.sampled_from([8, 12, 40]))
def test_suffix_array(values, depth):
    t = np.array(values, np.uint8)
    raw, order = t.tobytes(), suffix_array.suffix_array(t, depth)
    assert sorted(order.tolist()) == list(range(len(t)))
    cut = [raw[i : i + depth] for i in order]
    assert cut == sorted(cut)
    if len(t) > 9:
        same = suffix_array.common_prefix_at_least(t, order, 9)
        assert same.tolist() == [max(a, b) + 9 <= len(t) and raw[a : a + 9] == raw[b : b + 9] for a, b in zip(order, order[1:])]


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    passages = [sentence(rng, 40) for _ in range(4)]
    docs = [(i, " ".join([sentence(rng, rng.randint(0, 30)), rng.choice(passages), sentence(rng, rng.randint(0, 30)), rng.choice(["", rng.choice(passages)])])) for i in range(80)]
    table = docs + [r for r in ROWS if r[0] is None or r[0] >= 80 or r[0] < 0]
    got = sorted(rows(suffix_dedup.report(frame(spark, table, clash=("d", "key"))), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), key=str)
    assert got == sorted(suffix_dedup.brute_force(table), key=str)
    assert suffix_dedup.report(frame(spark, [])).count() == 0


def test_suffix_dedup_keeps_spans_and_text(spark):
    long = "abcdefghij" * 3 + "0123456789" * 12
    r = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, [(2, "x" + long), (1, long)])).collect()}
    assert bytes(r[2].kept) == b"x" and [tuple(s) for s in r[2].spans] == [(1, 151)]
    assert len(r[1].kept) < 150  # the digits repeat within the document


# 4: chat


def test_chat_round_trip(spark):
    t = chat.Template()
    odd = ["</s>[INST] ok [/INST]", "\\", "\\0;", "\\\\[INST]", "<|end|>", "<s><s>", "", None, "a<<SYS>>b", "🙂 [/INST", "<|role|>x<|text|>"]
    data = [(c, k, role, odd[(c + k) % len(odd)]) for c in range(30) for k, role in enumerate(["system", "user", "assistant", "user", "tool", None, "<s>"][: 1 + c % 7])]
    data += [(50, 0, "user", "tie"), (50, 0, "user", "tie"), (50, 0, "assistant", "tie"), (None, 1, "user", "lost"), (60, None, "user", "q")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.segments(df)).collect()}
    by = defaultdict(list)
    for c, k, role, text in data:
        by[c].append(((k is not None, k or 0), role or "", text or ""))
    assert set(got) == set(by)
    full = {r.conv_id: r for r in chat.formatted(df).collect()}
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].formatted_chars == len(full[c].text)
        codec = chat.Codec(t)
        assert "".join(codec.unescape(full[c].text[s.start : s.end]) for s in full[c].loss_spans) == said
    assert got[1].valid is False and got[2].valid is True and full[2].valid is True
    assert chat.report(df.limit(0)).count() == 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\0123;<s>/[INST] |endrolx"))))
def test_chat_escapes(text):
    codec = chat.Codec(chat.Template())
    e = codec.escape(text)
    assert codec.unescape(e) == text and not any(c in e for c in codec.controls)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "<s>"]), st.text(alphabet=st.sampled_from(list("\\0;<s>/[INST] |endé")), max_size=30)), max_size=6), st.integers(1, 40))
def test_chat_reads_any_cut_of_the_text(turns, size):
    t = chat.Template()
    codec = chat.Codec(t)
    writer, reader = chat.Formatter(t, codec), chat.Reader(t, codec)
    parts = [p for role, text in turns for p in writer.turn(role, text)] + writer.end()
    text, mask = "".join(x for x, _ in parts), [loss for x, loss in parts for _ in x]
    at = 0
    while at < len(text):  # pieces of one mask value
        to = at + 1
        while to < len(text) and to - at < size and mask[to] == mask[at]:
            to += 1
        reader.feed(text[at:to], mask[at])
        at = to
    reader.close()
    assert reader.turns == len(turns) and reader.sha.hexdigest() == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    said = "".join(x for r, x in turns if r in t.loss)
    assert reader.loss_chars == len(said) and reader.loss_sha.hexdigest() == hashlib.sha256(said.encode()).hexdigest()
    assert reader.valid == writer.valid and reader.chars == len(text)


def test_chat_needs_its_escapes():
    t, said = chat.Template(), "</s>[INST] ok [/INST]"

    class Bare(chat.Codec):
        def escape(self, text):
            return text

        def unescape(self, text):
            return text

    def read(codec):
        writer, reader = chat.Formatter(t, codec), chat.Reader(t, codec)
        reader.feed("".join(x for x, _ in [*writer.turn("user", said), *writer.turn("assistant", said), *writer.end()]), False)
        reader.close()
        return reader.turns

    assert read(chat.Codec(t)) == 2
    with pytest.raises(ValueError):
        read(Bare(t))


# 5: top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 8)).astype(np.float32))]
    data += [(1000 + i, data[100][1]) for i in range(40)] + [(2000, None), (2001, [float("nan")] * 8), (2002, [None] * 8), (2003, []), (2100, [0.0] * 8), (None, data[0][1]), (-100, data[1][1]), (2200, [1.0, 2.0])]
    data += [(5, data[300][1]), (300, data[5][1]), (300, data[300][1]), (7, [2.0] * 8), (7, [0.1] * 8), (2200, [2.0, 1.0])]  # ids that repeat, as rows of their own
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = sorted(rows(mtree.top_k(df, shard_rows=200, page=16), "query_id", "rank", "vec_id", "score"))
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in ((i, np.array(v, np.float32)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all())]
    want = []
    for row, (q, v) in enumerate(good):
        if q % 100 == 0:
            s = sorted((-int(v @ w), i) for other, (i, w) in enumerate(good) if other != row and len(w) == len(v))[:10]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert mtree.top_k(df.limit(0)).count() == 0


def test_columns_in_many_chunks():
    """What holds a group reads columns of any number of chunks and bytes: one chunk would end at 2 GB."""
    import pyarrow as pa

    from lexifold.llm import textblocks

    values = [b"abc", b"", None, b"0123456789", b"x" * 500]
    chunks = pa.chunked_array([pa.array(values[:2], pa.binary()), pa.array([], pa.binary()), pa.array(values[2:], pa.binary()).slice(1)])
    raw, off = textblocks.flat_bytes(chunks)
    assert [raw[a:b].tobytes() for a, b in zip(off, off[1:])] == [b"abc", b"", b"0123456789", b"x" * 500]
    assert [x.tolist() for x in textblocks.flat_bytes(pa.chunked_array([], pa.binary()))] == [[], [0]]
    sketches = np.arange(40, dtype=np.uint64).reshape(20, 2)
    whole = pa.array([s.tobytes() for s in sketches], pa.binary())
    one, many = (ngram_join.Sketches(c) for c in (pa.chunked_array([whole]), pa.chunked_array([whole.slice(i, 3) for i in range(0, 20, 3)])))
    assert one.words.tolist() == many.words.tolist() and one.start.tolist() == many.start.tolist()
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 9, n).astype("<i4") for n in rng.integers(1, 40, 60)]
    cols = {
        "shard": pa.array([3] * 60), "doc_id": pa.array(range(60)), "piece": pa.array([0] * 60, pa.int32()), "start": pa.array([0] * 60, pa.int32()),
        "n_tokens": pa.array([len(i) for i in ids], pa.int32()), "ids": pa.array([i.tobytes() for i in ids], pa.binary()),
    }
    t = pa.table(cols)
    cut = pa.concat_tables([t.slice(i, 7) for i in range(0, 60, 7)])
    a, b = (pa.Table.from_batches(packing._sequences(x, (16, 32, 64), 1, 0)).to_pylist() for x in (t, cut))
    assert a == b
    for r in a:
        for part in r["parts"]:
            assert r["ids"][part["bin_start"] :][: part["n_tokens"]] == ids[part["doc_id"]].tolist()


def test_top_k_of_large_components(spark):
    """Products beyond 64 bits: exact ranks, scores at the ends of a long."""
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in rng.integers(-(10**7), 10**7, 6)]) for i in range(250)] + [(300, [1e30] * 6), (301, [-1e30] * 6)]
    got = sorted(rows(mtree.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), shard_rows=100), "query_id", "rank", "vec_id", "score"))
    v = {i: [max(-(2**60), min(2**60, int(np.floor(1024 * x)))) for x in e] for i, e in data}
    top, want = 2**63 - 1, []
    for q in (0, 100, 200, 300):
        s = sorted((-sum(x * y for x, y in zip(v[q], v[i])), i) for i in v if i != q)[:10]
        want += [(q, k + 1, i, max(-top - 1, min(top, -x))) for k, (x, i) in enumerate(s)]
    assert got == want


def test_mtree_prunes():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c * 50, 1, (200, 3)) for c in range(10)])
    tree = mtree.MTree(points, 16)
    seen = []
    tree.search(points[5], lambda r: seen.extend(r.tolist()), lambda: 2.0)
    assert 0 < len(seen) < 400 and set(np.flatnonzero(np.sqrt(((points - points[5]) ** 2).sum(1)) <= 2).tolist()) <= set(seen)


# 6: decontamination


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _leaks(docs, items):
    win = defaultdict(set)
    for i, t in items:
        w = _words(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            win[tuple(w[p : p + 10])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, names = _words(t), set(), set()
        for n in {len(k) for k in win}:
            for p in range(len(w) - n + 1):
                k = tuple(w[p : p + n])
                if k in win:
                    hit.update(range(p, p + n))
                    names |= win[k]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randint(8, 25))) for i in range(12)] + [(50, "short one"), (51, "Short, ONE"), (52, ""), (53, None), (None, "seven paths where old trees hum slow songs to nobody"), (54, "zzz qqq")]
    docs = [(i, f"{sentence(rng, 20)}. {rng.choice(items)[1] or ''} {sentence(rng, 20)}".upper() if i % 3 else sentence(rng, 30)) for i in range(60)] + ROWS
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs, clash=("items", "spans"))
    found = decontaminate.scan(df.select("doc_id", "text"), bench, block_bytes=block_bytes)
    got = rows(found, "doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0)
    assert sorted(got, key=str) == sorted(_leaks(docs, items), key=str)
    left = decontaminate.remove_hits(df, bench).collect()
    assert {r.doc_id for r in left} == {x[0] for x in _leaks(docs, items) if not x[5] or x[2] < x[1]}
    assert left[0].items == "mine" and decontaminate.scan(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan(df.limit(0), bench).count() == 0


def test_removed_passages_are_gone(spark):
    p = "seven paths where old trees hum slow songs to nobody near the stone"
    docs = frame(spark, [(1, f"Before it. {p}! After it."), (2, p), (3, "clean text"), (4, None)])
    got = {r.doc_id: r for r in decontaminate.remove_hits(docs, spark.createDataFrame([(1, p)], "item_id long, text string")).collect()}
    assert got[1].text == "Before it.  ! After it." and got[1].n_chars == len(got[1].text) and 2 not in got and got[3].text == "clean text" and got[4].text is None


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index(runs, phrase):
    seq = np.array([x for r in runs for x in [*r, 0]])
    index = fmindex.FMIndex(seq, 4, sample=3)
    low, high = index.search(np.array([phrase]), np.array([len(phrase)]))
    got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert got == [i for i in range(len(seq) - len(phrase) + 1) if seq[i : i + len(phrase)].tolist() == phrase]


# 7: packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(sizes):
    where, offset, final = packing.best_fit(np.array(sizes, np.int64), (16, 32, 64), 2)
    used = defaultdict(list)
    for s, b, o in zip(sizes, where, offset):
        used[b].append((int(o), s))
    for b, parts in used.items():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [s for _, s in parts])[:-1].tolist()
        total = sum(s for _, s in parts)
        assert final[b] == min(c for c in (16, 32, 64) if c >= total)
    assert len(used) == len(final)


def _plain_best_fit(sizes, lengths, bin_cost):
    """The same choices by looking at every open bin."""
    cost = {c: c + bin_cost for c in lengths}
    worth = min(cost[c] / c for c in lengths)
    bins, where, offset = [], [0] * len(sizes), [0] * len(sizes)  # a bin: [room, used, when it last changed]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for step, i in enumerate(order):
        fits = [k for k, (room, _, _) in enumerate(bins) if room >= sizes[i]]
        if fits:  # least room; of equal ones the bin changed last
            k = min(fits, key=lambda k: (bins[k][0], -bins[k][2]))
        else:
            to_come, open_room = sum(sizes[j] for j in order[step + 1 :]), sum(b[0] for b in bins)
            price = {c: cost[c] - worth * (c - sizes[i]) * min(1.0, to_come / (open_room + c - sizes[i] + 1)) for c in lengths if c >= sizes[i]}
            bins.append([min(price, key=lambda c: (price[c], c)), 0, 0])
            k = len(bins) - 1
        where[i], offset[i] = k, bins[k][1]
        bins[k] = [bins[k][0] - sizes[i], bins[k][1] + sizes[i], step]
    return where, offset, [min(c for c in lengths if c >= used) for _, used, _ in bins]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(0, 9))
def test_best_fit_equals_brute_force(sizes, bin_cost):
    got = packing.best_fit(np.array(sizes, np.int64), (16, 32, 64), bin_cost)
    assert tuple(x.tolist() for x in got) == _plain_best_fit(sizes, (16, 32, 64), bin_cost)


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    df = frame(spark, ROWS, clash=("n_tokens", "bin_id", "ids", "shard"))
    got = packing.pack(df, lengths=(64, 256, 1024), shard_rows=30).collect()
    want, found = defaultdict(int), defaultdict(list)
    for i, x in ROWS:
        want[(i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2]))] += 1
    for r in got:
        assert len(r.ids) == r.capacity == min(c for c in (64, 256, 1024) if c >= r.n_ids) and set(r.ids[r.n_ids :]) <= {0}
        assert [p.bin_start for p in r.parts] == np.cumsum([0] + [p.n_tokens for p in r.parts])[:-1].tolist() and sum(p.n_tokens for p in r.parts) == r.n_ids
        for p in r.parts:
            assert p.start == 1024 * p.piece and p.n_tokens <= 1024
            found[p.doc_id].append((p.piece, r.ids[p.bin_start : p.bin_start + p.n_tokens]))
    assert len({r.bin_id for r in got}) == len(got)
    for i, pieces in found.items():  # an id with several rows: its pieces in any order
        whole = sorted(x for (d, ids), n in want.items() if d == i for k in range(0, len(ids), 1024) for x in [(k // 1024, list(ids[k : k + 1024]))] * n)
        assert sorted(pieces) == whole
    assert set(found) == {i for i, _ in want}
    assert sum(r.capacity for r in got) < 1.15 * sum(r.n_ids for r in got)
    assert packing.pack(df.limit(0)).count() == 0


# 8: token output


def test_token_output_reads_back(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    got = sorted(rows(token_output.report(frame(spark, ROWS, clash=("part", "blob"))), "start", "doc_id", "n_tokens", "ids_crc32"))
    at, want = 0, []
    for i, x in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_output.report(frame(spark, [])).count() == 0


def test_word_encoder_equals_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.default_path()), tokens.WordEncoder(tokens.read_tokenizer(tokens.default_path()))
    rng = random.Random(3)
    bits = ["a", "B", "é", "É", "'s", "'LL", "don't", ".", ",", "!!", " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\u0338", "\u0301", "=", "<", ">", "7", "12", "\u00a0", "中文", "İ", "ß", "Σ", "ς", "\x01", "\x00", "#", "$$", "(", ")", "…", "»", "\u2028", "ﬁ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    got = []
    for b in tb.blocks(pa.array(texts)):
        ids, sizes = e.encode(b)
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert e.counts(b).tolist() == sizes.tolist()
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def _shard_holds(docs, base, **how):
    ids = np.array([x for d in docs for x in [*d, 2]], np.int64)
    sizes = np.array([len(d) + 1 for d in docs])
    s = repair.Shard(repair.pack(ids, sizes, base, **how), 2)
    assert s.ids().tolist() == ids.tolist() and s.sizes.tolist() == sizes.tolist()
    for i, d in enumerate(docs):
        whole = [*d, 2]
        assert s.document(i).tolist() == whole
        assert s.slice(i, 1, len(whole) - 1).tolist() == whole[1:-1] and s.slice(i, len(d) // 2, 9999).tolist() == whole[len(d) // 2 :]
    return s


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=8))
def test_repair(docs):
    _shard_holds(docs, 5, least=2)


def test_repair_of_many_documents():
    rng = np.random.default_rng(8)
    phrases = [rng.integers(0, 3000, 40).tolist() for _ in range(30)]
    docs = [sum((phrases[k] if k < 30 else rng.integers(0, 3000, 9).tolist() for k in rng.integers(0, 60, rng.integers(0, 9))), []) for _ in range(3000)]
    docs += [docs[5] * 20] * 40 + [[7] * 5000, []]  # copies of a long text, one id over and over
    s = _shard_holds(docs, 3000)
    # almost no pair of what is left comes three times and could be replaced
    keys = defaultdict(list)
    ends = set((s.first[1:] - 1).tolist())
    for i, pair in enumerate(zip(s.symbols.tolist(), s.symbols[1:].tolist())):
        if i not in ends:
            keys[pair].append(i)
    assert sum(len(at) for (a, b), at in keys.items() if a != b and len(at) > 2) <= len(s.symbols) / 200
    with pytest.raises(ValueError):
        repair.pack(np.array([9, 2]), np.array([2]), 9)


def test_word_encoder_tells_ends_of_letter_words():
    """Letters that the tokenizer composes, decomposes or folds, and words that only look like letters."""
    from lexifold.llm.tokens import WordEncoder, default_path, read_tokenizer

    texts = ["\u0958\u0959 abc", "\ufb00 \ufb01 \u00e9a e\u0301", "\u0130stanbul \u00df \u017f", "", "\u4e2d\u6587\u5b57 abc", "\u01c5 \u02b0 \u00aa", "</w> w w</w>", "don't it's a\x01b"]
    encoder = WordEncoder(read_tokenizer(default_path()))
    (block,) = tb.blocks(pa.array(texts))
    ids, sizes = encoder.encode(block)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == encoder._ids(texts)


def test_word_encoder_of_another_tokenizer():
    """One that keeps white space: whole texts are encoded."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, " ": 1, "b": 2, "?": 3, "  ": 4}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
    e = tokens.WordEncoder(t.to_str())
    ids, sizes = e.encode(next(tb.blocks(pa.array(["a b", None, "b  a\n"]))))
    assert not e.by_word and sizes.tolist() == [3, 0, 4] and ids[:3].tolist() == [0, 1, 2] and e.size_of_vocabulary() == 5
    assert tokens.WordEncoder(tokens.read_tokenizer(tokens.default_path())).by_word


def test_word_encoder_keeps_the_ids_of_many_words():
    """Latin-1 words by the model alone, words that share a slot, and all of them again after the encoder forgot them."""
    from tokenizers import Tokenizer

    rng = random.Random(5)
    letters = "abcdefghijABCXYZ\u00e9\u00c9\u00df\u00b5\u00aa\u00ff\u0178\u01c5"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(4000)) for _ in range(3)]
    encoder = tokens.WordEncoder(tokens.read_tokenizer(tokens.default_path()))
    assert encoder.model is not None
    whole = Tokenizer.from_file(tokens.default_path())
    want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    most, tokens.MOST_WORDS = tokens.MOST_WORDS, 6000
    try:
        for text, ids in [*zip(texts, want), *zip(texts, want)]:
            assert encoder.encode(next(tb.blocks(pa.array([text]))))[0].tolist() == ids
    finally:
        tokens.MOST_WORDS = most
    # the vocabulary is looked through once, not for each block
    encoder.tokenizer = None
    assert encoder.size_of_vocabulary() == 1 + max(whole.get_vocab(with_added_tokens=True).values())


def _plain_round(seq, pairs, least):
    """(rank, place) of the pairs to replace, place by place: a better neighbour wins, of a run of equal pairs every second."""
    rank = {p: k for k, p in enumerate(pairs)}
    at = [rank.get(p, 99) for p in zip(seq, seq[1:])]
    order, run = [], 0
    for i, r in enumerate(at):
        run = run + 1 if i and at[i - 1] == r else 0
        order.append(2 * r + (run & 1))
    get = lambda i: order[i] if 0 <= i < len(order) else 999
    won = [(r, i) for i, r in enumerate(at) if r < 99 and get(i) < get(i - 1) and get(i) < get(i + 1)]
    times = [sum(r == k for r, _ in won) for k in range(99)]
    return [(r, i) for r, i in won if times[r] >= least]


@pytest.mark.parametrize("symbols", [3, 200])
def test_repair_round_equals_the_plain_one(symbols):
    """Also where only few places are looked at, and where key and place do not fit into 64 bits together."""
    rng = np.random.default_rng(symbols)
    for n in (2, 9, 40, 3000):
        seq = rng.integers(0, symbols, n).astype(np.uint32)
        for known in (symbols, 1 << 30):
            keys, places, bits = repair._order(seq, np.arange(n - 1), known)
            begin, count, _, _ = repair._frequent(keys, 2, 2, 6)
            if len(begin):
                pairs = [(int(k) >> bits, int(k) & ((1 << bits) - 1)) for k in keys[begin]]
                rank, at = repair._replace(n, places, begin, count, 2)
                assert list(zip(rank.tolist(), at.tolist())) == _plain_round(seq.tolist(), pairs, 2)


def test_repair_lengths():
    rules = np.array([[0, 1], [5, 5], [6, 2], [5, 0], [8, 7], [9, 9]])  # base 4, its end 4
    assert repair._lengths(rules, 4).tolist() == [1] * 5 + [2, 4, 5, 3, 8, 16]
    assert repair._lengths(np.zeros((0, 2), np.int64), 2).tolist() == [1, 1, 1]


# 10: n-gram join


def _near(docs, n, num):
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y) and sets[a][0] is not None and sets[b][0] is not None:
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)].append(i)
    return sorted(((i, len(s), min(least[root(k)]) if i is not None else None) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, n, num):
    rng = random.Random(n)
    docs = []
    for g in range(14):
        base = [f"w{g}x{rng.randint(0, 60)}" for _ in range(rng.choice([3, 6, 9, 20, 60, 150]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
            docs.append((len(docs) + 1000, " ".join(w)))
    table = docs + [r for r in ROWS if r[0] != 201]  # an id with two texts: see the next test
    j = ngram_join.JaccardJoin(frame(spark, table, clash=("set_key", "label")), n, num, 100)
    assert sorted(rows(j.membership(), "doc_id", "n_shingles", "component_id"), key=str) == _near(table, n, num)


def test_ngram_join_of_a_large_group_just_below(spark, monkeypatch):
    """500 sets that share most of their elements and are mostly a little too far apart."""
    rng = np.random.default_rng(5)
    n, slots = 500, 50
    kept, docs = np.ones((n, slots * 6 + 26), bool), []
    for i in range(n):
        w = [f"b{k}" for k in range(slots * 6 + 30)]
        for at in rng.choice(slots, 5, replace=False) * 6 + 10:
            w[at] = f"own{i}x{at}"
            kept[i, at - 4 : at + 1] = False
        docs.append((i + 7, " ".join(w)))
    same = kept.astype(np.float32) @ kept.T.astype(np.float32)
    size = kept.shape[1]
    link = 100 * same >= 80 * (2 * size - same)
    label = np.arange(n)
    while True:
        new = np.array([label[row].min() for row in link])
        if (new == label).all():
            break
        label = new
    monkeypatch.setattr(ngram_join, "SPLIT", 150)
    monkeypatch.setattr(ngram_join, "FIRST_SPLIT", 100)
    seen, plain = [], ngram_join.JaccardJoin._verified
    monkeypatch.setattr(ngram_join.JaccardJoin, "_verified", lambda self, pairs: seen.append(pairs.count()) or plain(self, pairs))
    got = rows(ngram_join.JaccardJoin(frame(spark, docs), 5, 80, 100).membership(), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == [(i + 7, size, int(label[i]) + 7) for i in range(n)]
    assert 10 < len(set(label)) < n - 10 and sum(seen) < 8 * n


def test_ngram_join_edges(spark):
    one = ngram_join.JaccardJoin(frame(spark, [(201, "one id " * 40), (201, "two texts " * 40), (7, "two texts " * 40)]), 4, 85, 100)
    assert sorted(rows(one.membership(), "doc_id", "component_id")) == [(7, 7), (201, 7), (201, 201)]
    assert ngram_join.JaccardJoin(frame(spark, [])).membership().count() == 0
    kept = ngram_join.keep_one(frame(spark, [(3, "a b c d e f"), (1, "A b c d e f"), (2, None), (4, ""), (9, "q")], clash=("set_key",)))
    assert sorted(rows(kept, "doc_id", "set_key")) == [(1, "mine"), (2, "mine"), (4, "mine"), (9, "mine")]
    # rows of one id go or stay by their own texts
    kept = ngram_join.keep_one(frame(spark, [(1, "a b c d e f g"), (3, "a b c d e f g"), (3, "q r s t u v w"), (5, "q r s t u v w")]))
    assert sorted(rows(kept, "doc_id", "text")) == [(1, "a b c d e f g"), (3, "q r s t u v w")]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 120), st.integers(0, 40), st.integers(0, 1000))
def test_linked_sets_share_a_signature(size, changed, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 54, size).astype(np.uint64))
    b = a.copy()
    b[: min(changed, len(b))] = rng.integers(0, 1 << 54, min(changed, len(b)))
    b = np.unique(b)
    both = len(np.intersect1d(a, b))
    for num in (80, 85, 95):
        if 100 * both >= num * (len(a) + len(b) - both):
            s, o = ngram_join.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), ngram_join.Bands(num, 100))
            assert set(s[o == 0].tolist()) & set(s[o == 1].tolist())


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 5, 40, 100, 290, 200)]
    first = np.cumsum([0] + [len(s) for s in sets])
    sk = ngram_join.Sketches(pa.chunked_array([ngram_join.odd_sketches(np.concatenate(sets), first)]))
    for i in range(6):
        d = sk.differ(np.full(6, i), np.arange(6))
        assert all(d[j] <= len(np.setxor1d(sets[i], sets[j])) for j in range(6)) and d[i] == 0


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (10, 10)] + [(i, i + 1) for i in range(20, 60)], "a long, b long")
    got = dict(rows(shared.components(e), "node", "component"))
    assert {got[i] for i in (3, 4, 5, 9)} == {3} and got[8] == 7 and 10 not in got and {got[i] for i in range(20, 61)} == {20}


