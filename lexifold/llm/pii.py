"""PII by information-theoretic sanitisation, with DataFrame functions only.

Base spans are email, ip, card and phone matches, leftmost and non-overlapping
per kind; matches that fail their check are dropped without another try. The
patterns here accept the same matches as the plain ones but never back-track
over long runs: possessive quantifiers, and starts only where a run begins or
the match before ended. Secrets are added spans: runs of 20 or more letters,
digits, underscores and plus signs with at least three digits, a letter and ten
different characters, as keys and tokens have.

Every value of such a span is a protected entity. Terms are runs of letters,
digits and underscores of any length outside all spans, in lower case; a
term and an entity meet where one text holds both, however far apart they stand.
With N texts, the pointwise mutual information of a term and an entity is
log2(p(term, entity) / (p(term) p(entity))), and the entity's information is
-log2 p(entity). The share of it that a term reveals is their quotient. Terms
that reveal at least `remove` of an entity, in at least `support` texts, are
removed wherever they stand in the table, beside a mention or not; from
`generalise` on they are replaced by a general mark. In a large table that share
is high for terms with which an entity is still unlikely, so p(entity | term)
must also reach `likely`. Of equal texts one counts. Positions are code points,
ends exclusive.

Texts themselves are not shuffled as long as the rows to be looked up are few
(FEW; beyond it they are joined by a shuffle): terms are counted in all rows and
the surplus of copied texts, one row for each of them, is taken off. All steps are linear in a text's length and, but for
a square root in the sums that give positions, in its spans.

Null texts are empty and have no spans. Equal rows get equal spans; rows that
share a doc_id but not the text, or have no doc_id, are told apart by the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

WORD = r"[A-Za-z0-9_\p{L}\p{M}\p{N}]++"
NOT_WORD = r"[^A-Za-z0-9_\p{L}\p{M}\p{N}]++"
KINDS = ("email", "ip", "card", "phone")
SPANS = (*KINDS, "secret")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "term": "[TERM]", "removed": ""}
#: rows that are sent to every task at most; more go through a shuffle
FEW = 1_000_000
#: characters of spans are moved here so that no later step takes them for parts of terms
AWAY = 0x10F000
CHUNK = 1024
_ASCII = "".join(map(chr, range(32, 127)))
_MOVED = "".join(chr(AWAY + ord(c)) for c in _ASCII)


def _patterns(moved: bool) -> dict[str, str]:
    """The pattern of each kind; moved: characters count the same where they have been moved."""

    def among(ranges: str, negative: str = "") -> str:
        """A class of single characters and a-b ranges, written one after the other."""
        out, i = "", 0
        while i < len(ranges):
            wide = ranges[i + 1 : i + 2] == "-" and i + 2 < len(ranges)
            ends = (ranges[i], ranges[i + 2]) if wide else (ranges[i],)
            out += "-".join(f"\\x{{{ord(c):x}}}" for c in ends)
            if moved:
                out += "-".join(f"\\x{{{AWAY + ord(c):x}}}" for c in ends)
            i += 3 if wide else 1
        return f"[{negative}{out}]"

    local, host, digit, dot = among("A-Za-z0-9._%+-"), among("A-Za-z0-9-"), among("0-9"), among(".")
    key = among("A-Za-z0-9_+")
    return {
        "email": rf"(?:\G|(?<!{local})){local}++{among('@')}{host}++(?:{dot}{host}++)++",
        "ip": rf"(?:\G|(?<!{digit})){digit}++(?:{dot}{digit}++){{3}}",
        "card": rf"{digit}(?:{among(' -')}?{digit})++",
        "phone": rf"{among('+')}{digit}{among(' ().0-9-')}+{digit}",
        "secret": rf"(?<!{key}){key}{{20,}}+",
    }


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(total, i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _ip_parts(m: Column) -> Column:
    def small(p):
        p = F.ltrim(p, F.lit("0"))
        return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))

    return F.forall(F.split(m, r"\."), small)


def _random(m: Column) -> Column:
    return (F.length(_digits(m)) >= 3) & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 10)


#: kind: a cheap test that every text with a valid match passes, and the check of a match
CHECKS = {
    "email": (lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip_parts),
    "card": (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _luhn),
    "phone": (lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(8, 15)),
    "secret": (lambda t: t.rlike("[0-9]") & t.rlike("(?<![A-Za-z0-9_+])[A-Za-z0-9_+]{20}"), _random),
}


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, fold, zero: Column) -> Column:
    """fold over values[0 .. i] for every i; fold is associative. About n ** 1.5 steps for n values, without growing arrays."""

    def total(part):
        return F.aggregate(part, zero, fold)

    def outer(v):
        n = F.size(v)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))

        def with_width(w):
            blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / w).cast("int")), lambda b: total(F.slice(v, b * w + 1, w)))

            def with_blocks(sums):
                before = F.transform(sums, lambda x, b: total(F.slice(sums, F.lit(1), b)))
                return _let(before, lambda p: F.transform(v, lambda x, i: fold(p[F.floor(i / w).cast("int")], total(F.slice(v, F.floor(i / w).cast("int") * w + 1, i % w + 1)))))

            return _let(blocks, with_blocks)

        return F.when(n == 0, v).otherwise(_let(width, with_width))

    return _let(values, outer)


def matches(text: Column, pattern) -> Column:
    """array<struct<start,end,value>> of the pattern's matches, left to right."""
    found = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def places(hits):
        step = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.char_length(g) + F.char_length(h))
        ends = _running(step, lambda a, b: a + b, F.lit(0))
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.char_length(h)).alias("start"), e.alias("end"), h.alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return _let(found, lambda hits: F.when(F.size(hits) == 0, none).otherwise(places(hits)))


def _found(docs: DataFrame) -> DataFrame:
    """docs with `text` (null: empty) and `spans`: kind (a place in SPANS), start, end and value."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    patterns = _patterns(False)
    rows = rows.select("*", *[F.when(CHECKS[k][0](F.col("text")), matches(F.col("text"), patterns[k])).otherwise(none).alias(f"__{k}") for k in SPANS])

    def valid(k, i):
        good = F.filter(f"__{k}", lambda s: CHECKS[k][1](s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return rows.select(*docs.columns, F.concat(*[valid(k, i) for i, k in enumerate(SPANS)]).alias("spans"))


def _plain(text: Column) -> Column:
    """text with the characters of its spans moved away, in place: no term has any of them."""
    patterns = _patterns(True)

    def mover(k):
        def move(t):
            hits = F.regexp_extract_all(t, F.lit(patterns[k]), F.lit(0))
            good = lambda h: CHECKS[k][1](F.translate(h, _MOVED, _ASCII))
            moved = F.transform(hits, lambda h: F.when(good(h), F.translate(h, _ASCII, _MOVED)).otherwise(h))
            joined = F.array_join(F.flatten(F.zip_with(F.split(t, patterns[k], -1), moved, lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))), "")
            return F.when(CHECKS[k][0](text), joined).otherwise(t)

        return move

    out = text
    for k in SPANS:
        out = _let(out, mover(k))
    return F.when(text.rlike("[0-9@]"), out).otherwise(text)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, tid, spans): one row a document.

    rid tells rows of one doc_id apart by their texts; tid is the text's.
    """
    return _found(docs.select("doc_id", "text")).select("doc_id", _rid().alias("rid"), _tid().alias("tid"), "spans")


def _rid() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))


def _tid() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _entities() -> Column:
    def key(m):
        return F.concat(m["kind"].cast("string"), F.lit(":"), F.when(m["kind"].isin(2, 3), _digits(m["value"])).when(m["kind"] == 4, m["value"]).otherwise(F.lower(m["value"])))

    return F.array_distinct(F.transform("spans", lambda m: F.xxhash64(key(m))))


def _terms() -> Column:
    """The distinct terms of a text, and an empty one."""
    return F.array_distinct(F.split(F.lower(_plain(F.coalesce("text", F.lit("")))), NOT_WORD))


def _exploded(rows: DataFrame, *keep) -> DataFrame:
    """The columns of keep and `term`, a hash, for every term of every row."""
    words = rows.select(*keep, F.explode(_terms()).alias("word")).where("word <> ''")
    return words.select(*keep, F.xxhash64("word").alias("term"))


def _looked_up(small: DataFrame, rows: int) -> DataFrame:
    """small, sent to every task if it has few rows."""
    return F.broadcast(small) if rows <= FEW else small


def disclosing(docs: DataFrame, support: int = 3, generalise: float = 0.7, remove: float = 0.9, likely: float = 0.5) -> DataFrame:
    """(term, removed): hashes of the terms that reveal an entity of the table."""
    base = cut(base_spans(docs))
    # one row stands for all of a text; `more` is the number of rows that it has besides
    stands = base.groupBy("tid").agg(F.min("rid").alias("rid"), (F.count("*") - 1).alias("more"), F.first("spans").alias("spans"))
    stands = cut(stands.select("rid", "more", F.when(F.size("spans") > 0, _entities()).alias("entities")))
    total = F.lit(float(max(stands.count(), 2)))
    held = stands.select(F.explode("entities").alias("entity"))
    entities = cut(held.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support))
    # what a term of such a row adds: to the count of each entity with it one, to its own the surplus (under no entity)
    often = stands.select("rid", F.explode("entities").alias("entity")).join(_looked_up(entities.select("entity"), entities.count()), "entity")
    adds = often.select("rid", "entity", F.lit(1).cast("long").alias("n")).union(stands.where("more > 0").select("rid", F.lit(None).cast("long"), -F.col("more")))
    adds = cut(adds.groupBy("rid").agg(F.collect_list(F.struct("entity", "n")).alias("adds"), F.count("*").alias("size")))
    size = adds.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # rows that are equal in every respect share a rid and count once
    rows = docs.select(_rid().alias("rid"), "text").join(_looked_up(adds.select("rid", "adds"), size), "rid").dropDuplicates(["rid"])
    added = _exploded(rows, "adds").select("term", F.explode("adds").alias("a")).groupBy("term", "a.entity").agg(F.sum("a.n").alias("n"))
    added = cut(added)
    evidence = added.where("entity is not null").select("term", "entity", F.col("n").alias("n_both")).where(F.col("n_both") >= support)
    every = _exploded(docs).groupBy("term").agg(F.count("*").alias("n"))
    spread = every.union(added.where("entity is null").select("term", "n")).groupBy("term").agg(F.sum("n").alias("n_term"))
    scored = evidence.join(entities, "entity").join(spread, "term")
    share = F.log2(F.col("n_both") * total / (F.col("n_term") * F.col("n_entity"))) / F.greatest(-F.log2(F.col("n_entity") / total), F.lit(1e-9))
    bad = scored.select("term", share.alias("share")).where((F.col("share") >= generalise) & (F.col("n_both") >= likely * F.col("n_term")))
    return cut(bad.groupBy("term").agg((F.max("share") >= remove).alias("removed")))


def _marked(docs: DataFrame, **how) -> DataFrame:
    """docs with `text` never null, `spans`, and `terms`: start, end and removed of the terms that disclose an entity."""
    own = docs.select("doc_id", "text")
    bad = disclosing(own, **how)
    met = _exploded(own.select(_rid().alias("rid"), "text"), "rid").join(_looked_up(bad, bad.count()), "term")
    by_row = cut(met.groupBy("rid").agg(F.collect_set(F.struct("term", "removed")).alias("__bad"), F.count("*").alias("n")))
    size = by_row.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_row = by_row.select(F.col("rid").alias("__rid"), F.map_from_entries("__bad").alias("__bad"))
    rows = _found(docs).join(_looked_up(by_row, size), _rid() == F.col("__rid"), "left")
    # what stands in the text for these terms
    words = F.array_distinct(F.regexp_extract_all(_plain(F.col("text")), F.lit(WORD), F.lit(0)))
    named = F.transform(words, lambda w: F.struct(w.alias("word"), F.try_element_at("__bad", F.xxhash64(F.lower(w))).alias("removed")))
    rows = rows.withColumn("__words", F.when(F.col("__rid").isNotNull(), F.filter(named, lambda w: w["removed"].isNotNull())))
    edge = WORD[:-2]
    listed = F.array_join(F.transform("__words", lambda w: w["word"]), "|")
    pattern = F.concat(F.lit(f"(?<!{edge})(?:"), listed, F.lit(f")(?!{edge})"))
    removed = F.map_from_entries("__words")
    places = F.transform(matches(_plain(F.col("text")), pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.element_at(removed, m["value"]).alias("removed")))
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    return rows.select(*docs.columns, "spans", F.when(F.size("__words") > 0, places).otherwise(none).alias("terms"))


def _written(spans: Column, name) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email .. n_phone, base_sha256, spans, n_secret, n_term of every document."""
    kinds = F.array(*[F.lit(k) for k in SPANS])
    written = _written(F.col("spans"), lambda s: F.element_at(kinds, s["kind"] + 1))
    base = _written(F.filter("spans", lambda s: s["kind"] < len(KINDS)), lambda s: F.element_at(kinds, s["kind"] + 1))
    term = _written(F.col("terms"), lambda s: F.lit("term"))
    found = _marked(docs.select("doc_id", "text")).select("doc_id", "spans", base.alias("b"), written.alias("w"), term.alias("t"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(F.array_join("b", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat("w", "t"), ",").alias("spans"), count(len(KINDS)).alias("n_secret"), F.size("t").cast("long").alias("n_term"),
    )


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of the text whose pieces of CHUNK characters are given."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    piece = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    one = F.substring(piece(a), start % CHUNK + 1, end - start)
    many = F.concat(F.substring(piece(a), start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(piece(b), F.lit(1), end % CHUNK))
    return F.when(start >= end, F.lit("")).when(a == b, one).otherwise(many)


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """docs with every span of text replaced by its mark; rows without spans stay as they are.

    Overlapping spans become one with the first one's mark (of equal starts, the shorter's).
    """
    columns = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(columns)], "doc_id", "text")
    marks = F.array(*[F.lit(MARKS[k]) for k in (*SPANS, "term", "removed")])
    kind = lambda s: F.when(s["removed"], F.lit(len(SPANS) + 1)).otherwise(F.lit(len(SPANS)))
    every = F.array_sort(
        F.concat(
            F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
            F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind"))),
        )
    )
    text = F.col("text")

    def clean(cuts):
        reach = _running(F.transform(cuts, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))

        def with_reach(ends):
            # a cut that begins before an earlier one ends is part of that one
            heads = F.filter(F.transform(cuts, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("reach"))), lambda s: s["start"] >= s["reach"])
            chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
            return _let(chunks, lambda c: F.concat(F.array_join(F.transform(heads, lambda s: F.concat(_between(c, s["reach"], s["start"]), F.element_at(marks, s["kind"] + 1))), ""), _between(c, F.element_at(ends, -1), F.char_length(text))))

        return _let(reach, with_reach)

    rows = _marked(own, **how).withColumn("__cuts", every)
    same = F.size("__cuts") == 0
    rows = rows.withColumn("__clean", F.when(~same, _let(F.col("__cuts"), clean)))
    out = []
    for i, c in enumerate(columns):
        value = F.col(f"__own_{i}")
        if c == "text":
            value = F.when(same, value).otherwise(F.col("__clean"))
        elif c == "n_chars":
            value = F.when(same, value).otherwise(F.char_length("__clean").cast("long"))
        out.append(value.alias(c))
    return rows.select(*out)


def oracle(support: int = 3, generalise: float = 0.7, likely: float = 0.5) -> str:
    """DuckDB SQL for report(), with the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "secret": r"[A-Za-z0-9_+]{20,}",
    }

    def places(source, text, pattern, keep):
        """Rows of source with v, s and e: each match and its place in text."""
        lists = f"SELECT *, regexp_extract_all({text}, '{pattern}') AS h, string_split_regex({text}, '{pattern}') AS g FROM {source}"
        return f"""SELECT {keep}, v, CAST(list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(h, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS s
            FROM (SELECT *, generate_subscripts(h, 1) AS i, unnest(h) AS v FROM ({lists}))"""

    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN CAST(x AS INT) * 2 - 9 ELSE CAST(x AS INT) * 2 END)) % 10 = 0"
    check = {
        "email": "true", "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15",
        "secret": f"length({digits}) >= 3 AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 10",
    }
    base = " UNION ALL ".join(f"SELECT r, {i} AS kind, s, s + length(v) AS e, v FROM ({places('d', 't', plain[k], 'r')}) WHERE {check[k]}" for i, k in enumerate(SPANS))
    names = f"{list(SPANS)}[kind + 1]"
    word = r"[\p{L}\p{M}\p{N}_]+"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED ({base}),
-- texts with blanks in place of spans, one row a row and, for the counts, one a text
c AS (SELECT r, list_distinct(flatten(list(range(s + 1, e + 1)))) AS at FROM b GROUP BY r),
p AS MATERIALIZED (SELECT d.r, d.t, CASE WHEN c.r IS NULL THEN t ELSE array_to_string(list_transform(string_split(t, ''), lambda x, i: CASE WHEN list_contains(c.at, i) THEN ' ' ELSE x END), '') END AS plain FROM d LEFT JOIN c USING (r)),
u AS MATERIALIZED (SELECT min(r) AS r, any_value(plain) AS plain FROM p GROUP BY t),
m AS MATERIALIZED (SELECT DISTINCT b.r, kind || ':' || CASE WHEN kind IN (2, 3) THEN {digits} WHEN kind = 4 THEN v ELSE lower(v) END AS entity FROM b SEMI JOIN u USING (r)),
w AS MATERIALIZED (SELECT DISTINCT r, unnest(regexp_extract_all(lower(plain), '{word}')) AS term FROM u),
y AS (SELECT entity, count(*) AS ne FROM m GROUP BY entity HAVING count(*) >= {support}),
x AS (SELECT entity, term, count(*) AS nb FROM m JOIN w USING (r) WHERE entity IN (SELECT entity FROM y) GROUP BY ALL HAVING count(*) >= {support}),
z AS (SELECT term, count(*) AS nt FROM w GROUP BY term),
n AS (SELECT CAST(greatest(count(*), 2) AS DOUBLE) AS n FROM u),
q AS MATERIALIZED (SELECT DISTINCT term FROM x JOIN y USING (entity) JOIN z USING (term), n WHERE log2(nb * n / (nt * ne)) / greatest(-log2(ne / n), 1e-9) >= {generalise} AND nb >= {likely} * nt),
k AS (SELECT p.r, p.plain FROM p SEMI JOIN (SELECT r FROM (SELECT r, unnest(regexp_extract_all(lower(plain), '{word}')) AS term FROM p) JOIN q USING (term)) USING (r)),
ts AS (SELECT r, count(*) AS n_term, string_agg('term:' || s || ':' || (s + length(v)), ',' ORDER BY s) AS j FROM ({places('k', 'plain', word, 'r')}) WHERE lower(v) IN (SELECT term FROM q) GROUP BY r),
bs AS (SELECT r, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(SPANS))}, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY kind, s) FILTER (kind < {len(KINDS)}) AS j, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY kind, s) AS w FROM b GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in SPANS)}, sha256(coalesce(bs.j, '')) AS base_sha256, concat_ws(',', bs.w, ts.j) AS spans, coalesce(n_term, 0) AS n_term
FROM d LEFT JOIN bs USING (r) LEFT JOIN ts USING (r)
"""
