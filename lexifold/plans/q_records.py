"""Queries of record stages, flow control and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import arrays, dates, geo, text
from ..operators import bayes, ordered, pages, phrases, records, segment  # noqa: F401  registers the stages
from ..sources import html, readers
from .pipeline import Context, compile_pipeline
from .registry import LOW, PLAIN, TOKENS, WORDS, register

Q: dict = {}
query = register(Q)


def _run(spark, d, *steps, ctx=None, df=None):
    return compile_pipeline(df if df is not None else catalog.paragraphs(spark, d), list(steps), ctx)


def _low(spark, d):
    return catalog.paragraphs(spark, d).select("id", "lang", text.words(F.lower("content")).alias("tokens"))


@query(r"SELECT doc_id AS id, regexp_replace(text, '([aeiou])t', '<\1>', 'g') AS content FROM documents")
def regex_replace(spark, d):
    return _run(spark, d, ["RegexReplace", {"pattern": r"([aeiou])t", "replacement": r"<\1>"}]).select("id", "content")


@query(r"SELECT doc_id AS id, regexp_extract(text, '(\w+)\.\n(\w+)', 2) || '-' || regexp_extract(text, '(\w+)\.\n(\w+)', 1) AS label FROM documents WHERE regexp_matches(text, '(\w+)\.\n(\w+)')")
def regex_filter_extract(spark, d):
    return _run(spark, d, ["RegexFilter", {"pattern": r"(\w+)\.\n(\w+)", "target": "label", "match": "{2}-{1}", "filter_out": True}]).select("id", "label")


@query(r"""WITH t AS (SELECT conv_id AS source, turn AS source_page, nullif(regexp_extract(text, '([A-Z][a-z]{7,})', 1), '') AS v FROM conversations)
SELECT source, source_page, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY source ORDER BY source_page ROWS UNBOUNDED PRECEDING), '') AS mark FROM t""")
def regex_filter_continuous(spark, d):
    return _run(spark, d, ["RegexFilter", {"pattern": "([A-Z][a-z]{7,})", "target": "mark", "match": "{1}", "continuous": True}], df=catalog.turns(spark, d)).select("source", "source_page", "mark")


@query(r"SELECT id, content, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '([A-Z][a-z]+)\.', 1)) AS content FROM documents) GROUP BY 1, 2")
def regex_matches(spark, d):
    return _run(spark, d, ["RegexMatches", {"regex": r"([A-Z][a-z]+)\."}]).groupBy("id", "content").agg(F.count("*").alias("n"))


@query("SELECT id, content, count(*) AS n FROM (SELECT doc_id AS id, unnest(string_split(text, '.')) AS content FROM documents) WHERE content <> '' GROUP BY 1, 2")
def split_paragraph(spark, d):
    return _run(spark, d, ["SplitParagraph", {"delimeter": "."}]).groupBy("id", "content").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, CASE WHEN lang IN ('de', 'en') THEN upper(lang) ELSE 'other' END AS label FROM documents")
def field_assign(spark, d):
    return _run(spark, d, ["FieldAssignment", {"field": "label", "value": "upper(lang) if lang in ('de', 'en') else other"}]).select("id", "label")


@query("SELECT doc_id AS id, length(text) + length(text) * 2 + 1 AS n FROM documents")
def field_increment(spark, d):
    return _run(spark, d, ["FieldIncresement", {"field": "n", "inc_value": "n * 2 + 1"}]).select("id", "n")


@query("SELECT doc_id AS id, CASE WHEN length(text) > 5000 THEN 'long' WHEN lang = 'en' THEN 'english' ELSE lang END AS lang FROM documents")
def conditional_assign(spark, d):
    return _run(spark, d, ["ConditionalAssignment", {"cond": "n > 5000 => long\nlang == en => english", "field": "lang"}]).select("id", "lang")


@query("SELECT doc_id AS id, lang, length(text) AS n FROM documents WHERE NOT (lang = 'en' AND length(text) < 2000)")
def filter_out(spark, d):
    return _run(spark, d, ["FilterOut", {"cond": "lang == 'en' and n < 2000"}]).select("id", "lang", "n")


@query(f"WITH {LOW} SELECT id, array_to_string(list_concat(tokens, ['x', lang]), ' ') AS tokens FROM p")
def array_push(spark, d):
    return _run(spark, d, ["ArrayField", {"field": "tokens", "push": True, "elements": "'x'\nlang"}], df=_low(spark, d)).select("id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {LOW}, q AS (SELECT id, tokens, list_position(tokens, 'the') AS k FROM p)
SELECT id, array_to_string(CASE WHEN coalesce(k, 0) = 0 THEN tokens ELSE list_concat(list_slice(tokens, 1, k - 1), list_slice(tokens, k + 1, len(tokens))) END, ' ') AS tokens FROM q""")
def array_remove_first(spark, d):
    return _run(spark, d, ["ArrayField", {"field": "tokens", "push": False, "elements": "'the'"}], df=_low(spark, d)).select("id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {LOW} SELECT id, len(tokens) * 2 AS n FROM p")
def array_flatten(spark, d):
    df = _low(spark, d).withColumn("nested", F.array("tokens", F.array().cast("array<string>"), "tokens"))
    return _run(spark, d, ["ArrayAggregation", {"field": "nested", "new_field": "flat"}], df=df).select("id", F.size("flat").cast("long").alias("n"))


@query(f"""WITH {LOW}, q AS (SELECT id, tokens, list_position(tokens, 'de') AS k FROM p)
SELECT id, array_to_string(CASE WHEN coalesce(k, 0) = 0 THEN tokens ELSE list_concat(list_concat(list_slice(tokens, 1, k - 1), list_slice(tokens, k + 1, len(tokens))), ['OF']) END, ' ') AS tokens FROM q""")
def keyword_replace(spark, d):
    return _run(spark, d, ["KeywordsReplacement", {"from_tag": "de", "to_tag": "OF", "arr": "tokens"}], df=_low(spark, d)).select("id", F.array_join("tokens", " ").alias("tokens"))


@query(f"SELECT doc_id AS id, array_to_string(list_sort(list_distinct({TOKENS})), ' ') AS words FROM documents")
def wordcut(spark, d):
    return _run(spark, d, ["WordCut", {}]).select("id", F.array_join(F.array_sort("keywords"), " ").alias("words"))


@query(f"""WITH {LOW} SELECT id, array_to_string(list_filter(tokens, lambda w: NOT list_contains(['x', 'on'], w) AND NOT list_contains(CASE lang WHEN 'en' THEN ['the', 'of'] WHEN 'de' THEN ['der', 'die'] ELSE [] END, w)), ' ') AS tokens FROM p""")
def stopwords(spark, d):
    return _run(spark, d, ["FilterStopWords", {"stopwords": "x on", "table": {"en": ["the", "of"], "de": ["der", "die"]}}], df=_low(spark, d)).select("id", F.array_join("tokens", " ").alias("tokens"))


@query(r"""SELECT doc_id AS id, regexp_replace(trim(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~'), '[\s().?!,''":/\\-]', '', 'g') AS content FROM documents""")
def filter_punct(spark, d):
    return _run(spark, d, ["FilterPunctuations", {}]).select("id", "content")


@query(r"""SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS content FROM documents""")
def text_clean(spark, d):
    return _run(spark, d, ["TextCleaner", {"remove_garbled": False}]).select("id", "content")


@query(r"""WITH t AS (SELECT doc_id AS id, length(text) AS n, length(regexp_replace(text, '[\p{L}\p{N}\s.,!?;:()\[\]{}"''\-–—…]', '', 'g')) AS special, regexp_replace(text, '[^\p{L}]', '', 'g') AS a FROM documents),
u AS (SELECT *, length(a) AS m, len(regexp_extract_all(regexp_replace(regexp_replace(a, '\p{Ll}+', 'l', 'g'), '[^l]+', 'U', 'g'), '.')) - 1 AS changes FROM t)
SELECT id, n >= 10 AND (special > 0.3 * n OR (m > 10 AND changes > 0.6 * m)) AS garbled FROM u""")
def garbled_flag(spark, d):
    return catalog.paragraphs(spark, d).select("id", text.is_garbled("content").alias("garbled"))


@query(r"""WITH t AS (SELECT doc_id AS id, length(regexp_replace(text, '\s', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z\x{00C0}-\x{024F}]', '', 'g')) AS latin, length(regexp_replace(text, '[^\x{0400}-\x{04FF}]', '', 'g')) AS cyrillic,
length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) AS han, length(regexp_replace(text, '[^\x{3040}-\x{30FF}]', '', 'g')) AS kana, length(regexp_replace(text, '[^\x{AC00}-\x{D7AF}]', '', 'g')) AS hangul FROM documents)
SELECT id, CASE WHEN n = 0 THEN NULL WHEN hangul > 0 THEN 'ko' WHEN kana > 0.3 * n THEN 'ja' WHEN han > 0.5 * n THEN 'zh' WHEN cyrillic > 0.5 * n THEN 'ru' END AS script, round(latin / n, 6) AS latin, round(greatest(cyrillic, han, kana, hangul) / n, 6) AS other FROM t""".replace("\\", "\\"))
def script_lang_detect(spark, d):
    """The scripts of whole texts."""
    n = text.script_counts("content")
    other = F.greatest(*[n[k] for k in ("cyrillic", "han", "kana", "hangul")])
    share = lambda c: F.round(F.try_divide(c, n["all"]), 6)
    return catalog.paragraphs(spark, d).select("id", text.script_language("content").alias("script"), share(n["latin"]).alias("latin"), share(other).alias("other"))


_TRIPLES = "c AS (SELECT doc_id AS id, lang, list_transform(string_split(text, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c FROM documents WHERE length(text) > 2), g AS (SELECT id, lang, (unnest(c[:-3]) * 961 + unnest(c[2:-2]) * 31 + unnest(c[3:])) % 65536 AS f FROM c)"


@query(f"""WITH {_TRIPLES}, n AS (SELECT lang AS label, f, count(*) AS n FROM g WHERE id % 4 <> 2 GROUP BY 1, 2), t AS (SELECT label, sum(n) AS total FROM n GROUP BY 1), d AS (SELECT id, f, count(*) AS k FROM g GROUP BY 1, 2),
s AS (SELECT d.id, t.label, sum(k * ln((coalesce(n.n, 0) + 1) / (t.total + 65536))) AS s FROM d CROSS JOIN t LEFT JOIN n ON n.label = t.label AND n.f = d.f GROUP BY 1, 2),
b AS (SELECT id, max(s) AS m FROM s GROUP BY 1) SELECT id, arg_max(label, s) AS lang, round(1 / sum(exp(greatest(s - m, -700))), 6) AS confidence FROM s JOIN b USING (id) GROUP BY id
UNION ALL SELECT doc_id, 'en', 0.5 FROM documents WHERE text IS NULL OR length(text) < 3""")
def language_detect(spark, d):
    """Languages told by a model that three quarters of the documents give; whole texts."""
    p = catalog.paragraphs(spark, d)
    model = bayes.LANGUAGES.fit(p.where("id % 4 <> 2"), "content", "lang")
    df = p.select("id", "content", F.lit("auto").alias("lang"))
    found = compile_pipeline(df, [["PDFLanguageDetect", {}]], Context(named={"language_model": model}))
    return found.select("id", "lang", F.round("lang_confidence", 6).alias("confidence"))


_WORDS31 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""WITH w AS (SELECT doc_id AS id, unnest({_WORDS31}) AS w FROM documents), v AS (SELECT w, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, x: (a * 31 + x) % 262144) AS f FROM (SELECT DISTINCT w FROM w)),
d AS (SELECT id, f, count(*) AS k FROM w JOIN v USING (w) GROUP BY 1, 2), l AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label FROM labels WHERE doc_id % 4 <> 2),
n AS (SELECT label, f, sum(k) AS n FROM d JOIN l USING (id) GROUP BY 1, 2), t AS (SELECT label, sum(n) AS total FROM n GROUP BY 1),
s AS (SELECT d.id, t.label, sum(k * ln((coalesce(n.n, 0) + 1) / (t.total + 262144))) AS s FROM d CROSS JOIN t LEFT JOIN n ON n.label = t.label AND n.f = d.f GROUP BY 1, 2),
p AS (SELECT id, 1 / (1 + exp(least(greatest(max(CASE label WHEN 'negative' THEN s END) - max(CASE label WHEN 'positive' THEN s END), -700), 700))) AS p FROM s GROUP BY 1)
SELECT doc_id AS id, round(coalesce((p - 0.5) * 2, 0), 5) AS sentiment FROM documents LEFT JOIN p ON p.id = doc_id""")
def sentiment_bayes(spark, d):
    """From -1 to 1; learnt from rows whose label of quality stands for a sentiment, three quarters of them."""
    p = catalog.paragraphs(spark, d)
    label = F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label")
    labels = catalog.table(spark, d, "labels").where("doc_id % 4 <> 2").select(F.col("doc_id").alias("id"), label)
    model = bayes.SENTIMENT.fit(p.join(labels, "id"), "content", "label")
    found = compile_pipeline(p.select("id", "content"), [["AutoSentimentAnalysis", {}]], Context(named={"sentiment_model": model}))
    return found.select("id", F.round("sentiment", 5).alias("sentiment"))


_LETTERS = {"é": "e", "è": "e", "ß": "ss", "ä": "ae", "ö": "oe", "ü": "ue", "ñ": "nh", "ç": "c"}


def _replaced(sql: str) -> str:
    for k, v in _LETTERS.items():
        sql = f"replace({sql}, '{k}', '{v}')"
    return sql


@query(f"SELECT doc_id AS id, {_replaced('text')} AS content FROM documents")
def phrase_replace(spark, d):
    """A table of replacements over whole texts, as one automaton."""
    return _run(spark, d, ["TradToSimpChinese", {"table": _LETTERS}]).select("id", "content")


@query("""WITH p AS (SELECT DISTINCT regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+') AS phrase FROM benchmark), q AS (SELECT phrase FROM p WHERE phrase <> '' AND length(phrase) >= 8)
SELECT phrase, CAST(sum((length(text) - length(replace(text, phrase, ''))) / length(phrase)) AS BIGINT) AS n FROM q, documents GROUP BY phrase""")
def phrase_counts(spark, d):
    """How often the beginnings of benchmark items stand in the documents."""
    phrase = F.regexp_extract("text", "^[^ ]+ [^ ]+ [^ ]+", 0).alias("phrase")
    table = catalog.table(spark, d, "benchmark").select(phrase, F.lit("item").alias("value")).where(F.char_length("phrase") >= 8)
    return phrases.count_phrases(catalog.paragraphs(spark, d), "content", table)


@query(None)
def wordcut_graph(spark, d):
    """Texts written without spaces, cut along the most probable path of the corpus's frequent words (at most one in 20000 tokens is rarer)."""
    p = catalog.paragraphs(spark, d)
    words = p.select(F.explode(text.words(F.lower("content"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n").alias("total"))
    table = words.join(F.broadcast(total)).where(F.col("n") * 20000 >= F.col("total")).select("phrase")
    low = p.select("id", F.lower("content").alias("content"))
    model = segment.fit(low, table)
    joined = low.select("id", F.regexp_replace("content", r"\s+", "").alias("content"), F.lit("zh").alias("lang"))
    cut = compile_pipeline(joined, [["WordCut", {"field": "tokens"}]], Context(named={"segmentation": model}))
    return cut.select("id", F.size("tokens").alias("n"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN make_timestamp(2024, month(o_orderdate), day(o_orderdate), 0, 0, 0) ELSE date_trunc('day', o_orderdate) END AS pdate FROM orders""")
def date_extract(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(day, "'on 'yyyy-M-d' it was'")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).when(k == 2, F.date_format(day, "yyyy'年'M'月'd'日'")).otherwise(F.date_format(day, "'am 'M'月'd'日'"))
    return catalog.table(spark, d, "orders").select("o_orderkey", dates.extract_time(t, "2024-06-15 12:00:00").alias("pdate"))


@query("""WITH r AS (SELECT DISTINCT p_size FROM part), x AS (SELECT p_size, list_sort(list_concat(range(p_size - 1, p_size + 2), [p_size + 9])) AS pages FROM r) SELECT p_size, array_to_string(pages, ',') AS pages FROM x""")
def page_range(spark, d):
    p = catalog.table(spark, d, "part").select("p_size").distinct()
    spec = F.concat_ws(",", F.concat_ws("-", F.col("p_size"), F.col("p_size") + 2), F.lit("x-2"), (F.col("p_size") + 10).cast("string"), F.lit(""))
    return p.select("p_size", F.array_join(arrays.page_range(spec), ",").alias("pages"))


@query("SELECT doc_id AS id, strip_accents(text) AS content FROM documents")
def accent_strip(spark, d):
    return catalog.paragraphs(spark, d).select("id", text.strip_accents("content").alias("content"))


@query(f"WITH {PLAIN} SELECT id, source FROM p ORDER BY source, id LIMIT 100")
def limit_global(spark, d):
    return _run(spark, d, ["Limit", {"limit": 100}]).select("id", "source")


@query(f"WITH {PLAIN} SELECT id, n FROM p WHERE lang = 'fr'")
def named_result(spark, d):
    return _run(spark, d, ["FilterOut", {"cond": "lang != fr"}], ["SetNamedResult", {"name": "french"}], ["FilterOut", {"cond": "n > 100"}], ["LoadNamedResult", {"name": "french"}]).select("id", "n")


@query("""WITH t AS (SELECT conv_id AS source, turn AS source_page, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT source, source_page, '00.' || lpad(CAST(k AS VARCHAR), 2, '0') || '.00' AS outline FROM t""")
def outline_running(spark, d):
    from pyspark.sql import Window

    t = catalog.turns(spark, d)
    k = F.row_number().over(Window.partitionBy("source").orderBy("source_page"))
    marked = t.withColumn("content", F.concat(F.lit("Chapter "), k.cast("string"), F.lit(" of it")))
    return _run(spark, d, ["OutlineFilter", {"order": ["source_page"]}], df=marked).select("source", "source_page", "outline")


@query(None)
def reparagraph(spark, d):
    return _run(spark, d, ["Reparagraph", {}]).select("id", "content")


@query(r"""WITH p AS (SELECT conv_id AS source, turn AS page, md5(text) AS tie, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM conversations WHERE text IS NOT NULL),
l AS (SELECT source, page, tie, line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM p),
k AS (SELECT * FROM l WHERE t <> '' AND NOT (length(t) <= 100 AND regexp_matches(t, '(?i)^(\d+|\d+\s*of\s*\d+|page\s*\d+|-\s*\d+\s*-|[©®&]\s*\d{4}.*|[-—•*])$'))),
a AS (SELECT *, lag(t) OVER w AS b, CAST(length(t) < 30 AS INTEGER) AS s FROM k WINDOW w AS (PARTITION BY source ORDER BY page, tie, line)),
f AS (SELECT *, b IS NULL OR (regexp_matches(b, '[.!?。！？…:：]$') AND regexp_matches(t, '^[\p{Lu}\x{4E00}-\x{9FFF}]')) OR (length(b) > 100 AND length(t) < 20) AS begins, sum(s) OVER w AS shorts FROM a WINDOW w AS (PARTITION BY source ORDER BY page, tie, line)),
g AS (SELECT *, s = 1 AND (shorts - max(CASE WHEN begins OR s = 0 THEN shorts - s END) OVER w) % 5 = 0 AS closes FROM f WINDOW w AS (PARTITION BY source ORDER BY page, tie, line)),
h AS (SELECT *, begins OR coalesce(lag(closes) OVER w, false) AS new FROM g WINDOW w AS (PARTITION BY source ORDER BY page, tie, line)),
i AS (SELECT *, sum(CAST(new AS INTEGER)) OVER w AS para, regexp_extract_all(t, '[^.!?。！？…:：]*[.!?。！？…:：]+|[^.!?。！？…:：]+$') AS parts FROM h WINDOW w AS (PARTITION BY source ORDER BY page, tie, line)),
j AS (SELECT source, page, tie, line, new, para, unnest(parts) AS t, generate_subscripts(parts, 1) AS piece FROM i),
m AS (SELECT *, sum(length(t) + CAST(piece = 1 AS INTEGER)) OVER w - length(t) - CAST(piece = 1 AS INTEGER) AS place, new AND piece = 1 AS head, (new AND piece = 1) OR regexp_matches(lag(t) OVER w, '[.!?。！？…:：]$') AS opens FROM j WINDOW w AS (PARTITION BY source ORDER BY page, tie, line, piece)),
n AS (SELECT *, max(CASE WHEN head THEN place END) OVER w AS base, max(CASE WHEN opens THEN place END) OVER w AS begun FROM m WINDOW w AS (PARTITION BY source ORDER BY page, tie, line, piece)),
o AS (SELECT *, floor(((CASE WHEN place - begun > 2000 THEN place ELSE begun END) - base) / 2000) AS part FROM n),
q AS (SELECT source, min(page) AS source_page, regexp_replace(string_agg(CASE WHEN piece = 1 THEN ' ' ELSE '' END || t, '' ORDER BY page, tie, line, piece), '^\s+|\s+$', '', 'g') AS content FROM o GROUP BY source, para, part)
SELECT source, CAST(source_page AS INTEGER) AS source_page, CAST(source_page + 1 AS VARCHAR) AS pagenum, content FROM q WHERE length(content) >= 50""")
def cross_page(spark, d):
    return _run(spark, d, ["CrossPageReparagraphizer", {}], df=catalog.turns(spark, d).withColumn("source_page", F.col("source_page").cast("int")))


@query("SELECT doc_id AS id, 'corpus--' || lang || '--' || source AS dataset_name FROM documents")
def dataset_from_field(spark, d):
    df = catalog.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return _run(spark, d, ["DatasetFromField", {"pattern": "corpus--{lang}--{source}"}], df=df).select("id", "dataset_name")


@query("""WITH c AS (SELECT c_custkey AS id, 31 + (c_custkey % 100) / 25.0 AS a, 104 + (c_custkey % 7) * 1.5 AS b FROM customer), x AS (SELECT *, b - 105 AS x, a - 35 AS y, (20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3 AS w, 1 - 0.00669342162296594323 * sin(radians(a)) ** 2 AS m FROM c),
o AS (SELECT *, -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + w + (20 * sin(y * pi()) + 40 * sin(y / 3 * pi())) * 2 / 3 + (160 * sin(y / 12 * pi()) + 320 * sin(y * pi() / 30)) * 2 / 3 AS p,
300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + w + (20 * sin(x * pi()) + 40 * sin(x / 3 * pi())) * 2 / 3 + (150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3 AS q FROM x)
SELECT id, round(a - p * 180 / (6378245.0 * (1 - 0.00669342162296594323) / (m * sqrt(m)) * pi()), 6) AS lat, round(b - q * 180 / (6378245.0 / sqrt(m) * cos(radians(a)) * pi()), 6) AS lng FROM o""")
def geo_roundtrip(spark, d):
    """Points (a customer's stands for an address) in WGS-84."""
    c = catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array((31 + (F.col("c_custkey") % 100) / 25.0), (104 + (F.col("c_custkey") % 7) * 1.5)).alias("p"))
    moved = _run(spark, d, ["GCJtoWGS", {"field": "p", "in_format": "latlng"}], df=c)
    return moved.select("id", F.round(F.col("p")[0], 6).alias("lat"), F.round(F.col("p")[1], 6).alias("lng"))


# flow control


@query(f"WITH {PLAIN} SELECT id, 'big' AS label FROM p WHERE n >= 4000 UNION ALL SELECT id, lang AS label FROM p WHERE n < 4000")
def condition_branch(spark, d):
    return _run(spark, d, ["Condition", {"cond": "n >= 4000", "iftrue": [["FieldAssignment", {"field": "label", "value": "big"}]], "iffalse": [["FieldAssignment", {"field": "label", "value": "lang"}]]}]).select("id", "label")


@query(f"WITH {LOW}, q AS (SELECT id, unnest(tokens) || '!' AS w FROM p UNION ALL SELECT id, NULL AS w FROM p) SELECT id, w, count(*) AS n FROM q GROUP BY 1, 2")
def foreach_explode(spark, d):
    out = _run(spark, d, ["ForEach", {"field": "tokens", "as_name": "w", "pipeline": [["FieldAssignment", {"field": "w", "value": "w + '!'"}]]}], df=_low(spark, d))
    return out.groupBy("id", "w").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {PLAIN}, r AS (SELECT id, n, 0 AS k FROM p UNION ALL SELECT id, n // 2, k + 1 FROM r WHERE n > 1000 AND k < 4) SELECT id, arg_max(n, k) AS n FROM r GROUP BY id")
def repeat_while(spark, d):
    return _run(spark, d, ["RepeatWhile", {"cond": "n > 1000", "times": 4, "pipeline": [["FieldAssignment", {"field": "n", "value": "n // 2"}]]}]).select("id", F.col("n").cast("long").alias("n"))


@query(f"WITH {PLAIN} SELECT id, lang, n FROM p WHERE lang = 'de' UNION ALL SELECT id, lang, n FROM p WHERE n > 6000")
def aggregate_sources_union(spark, d):
    return _run(spark, d, ["AggregateDataSource", {"pipelines": [[["FilterOut", {"cond": "lang != de"}]], [["FilterOut", {"cond": "n <= 6000"}]]]}]).select("id", "lang", "n")


@query(f"WITH {PLAIN} SELECT id, 'es' AS tag FROM p WHERE lang = 'es'")
def call_task_inline(spark, d):
    task = [["Passthrough", {}], ["FilterOut", {"cond": "lang != de"}], ["FieldAssignment", {"field": "tag", "value": "lang"}]]
    return _run(spark, d, ["CallTask", {"task": "t", "skip": 1, "params": {"1.cond": "lang != es"}}], ctx=Context(tasks={"t": task})).select("id", "tag")


# sources


@query(r"SELECT doc_id AS id, lang, 'corpus' AS dataset_name, CAST(k - 1 AS INTEGER) AS pos, content FROM (SELECT doc_id, lang, generate_subscripts(l, 1) AS k, unnest(l) AS content FROM (SELECT doc_id, lang, string_split(text, '. ') AS l FROM documents)) WHERE content <> ''")
def lines_source(spark, d):
    """Each record is a source of its own: its text, cut at a delimiter, its other fields before the stage's arguments."""
    from . import stages  # noqa: F401  registers the stage

    df = catalog.paragraphs(spark, d).select("id", "lang", "content")
    return _run(spark, d, ["LinesDataSource", {"delimiter": ". ", "dataset_name": "corpus", "lang": "xx"}], df=df).select("id", "lang", "dataset_name", "pos", "content")


@query(r"SELECT doc_id AS id, lpad(CAST(k AS VARCHAR), 6, '0') AS outline, content FROM (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS content FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents))")
def numbered_lines(spark, d):
    return readers.numbered_lines(catalog.paragraphs(spark, d).select("id", "content")).select("id", "outline", "content")


@query(r"""WITH m AS (SELECT conv_id, string_agg(repeat('#', CAST(turn % 3 + 1 AS INTEGER)) || ' ' || role || ' ' || turn || chr(10) || replace(text, '#', ''), chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id)
SELECT conv_id AS source, role || ' ' || turn AS outline, CAST(turn % 3 + 1 AS INTEGER) AS heading_level, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) AS pagenum, regexp_replace(replace(text, '#', ''), '^\s+|\s+$', '', 'g') AS content FROM conversations""")
def markdown_sections(spark, d):
    c = catalog.table(spark, d, "conversations")
    part = F.concat(F.expr("repeat('#', cast(turn % 3 + 1 as int))"), F.lit(" "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.replace("text", F.lit("#"), F.lit("")))
    md = c.groupBy(F.col("conv_id").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda s: s["p"]), "\n").alias("content"))
    return readers.markdown_sections(md).select("source", "outline", "heading_level", "pagenum", "content")


_PLAIN_SQL = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query("SELECT page_id, " + _PLAIN_SQL.format(r"regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)") + " AS title FROM pages")
def html_title(spark, d):
    return catalog.table(spark, d, "pages").select("page_id", html.title("html").alias("title"))


@query("SELECT page_id, content, count(*) AS n FROM (SELECT page_id, " + _PLAIN_SQL.format("x") + r" AS content FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1)) AS x FROM pages)) WHERE content <> '' GROUP BY 1, 2")
def html_paragraphs(spark, d):
    return catalog.table(spark, d, "pages").select("page_id", F.explode(html.paragraphs_of("html")).alias("content")).groupBy("page_id", "content").agg(F.count("*").alias("n"))


_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']"""


@query(f"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href FROM pages) GROUP BY 1, 2")
def html_links(spark, d):
    return catalog.table(spark, d, "pages").select("page_id", F.explode(html.links("html")).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(None)
def html_select(spark, d):
    p = catalog.table(spark, d, "pages")
    return html.extract(p, "html", {"content": "p", "outline": "h1", "keywords": "a//href"}).select("page_id", "outline", "content", F.array_join("keywords", " ").alias("keywords"))


@query(rf"""WITH RECURSIVE k AS (SELECT regexp_replace(url, '#.*$', '') AS url, min(page_id) AS page_id FROM pages GROUP BY 1), h AS (SELECT k.url, html FROM k JOIN pages USING (page_id)),
l AS (SELECT DISTINCT url, regexp_replace(CASE WHEN regexp_replace(x, '#.*$', '') = '' THEN url WHEN regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN x WHEN x LIKE '//%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || x
  WHEN x LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || x ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || regexp_replace(CASE WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(/.*)?$', 1) = '' THEN '/' ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(/.*)?$', 1) END, '[^/]*$', '') || x END, '#.*$', '') AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS x FROM h)),
s AS (SELECT min(url) AS url FROM k),
r AS (SELECT url, 0 AS depth FROM s UNION SELECT l.target, r.depth + 1 FROM r JOIN l ON l.url = r.url WHERE r.depth < 3 AND l.target IN (SELECT url FROM k))
SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def crawl_bfs(spark, d):
    p = catalog.table(spark, d, "pages")
    start = p.agg(F.min(F.regexp_replace("url", "#.*$", ""))).first()[0]
    return html.crawl(p, [start], 3)


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 1000 + o_orderkey % 7, 2 * count(*) FROM orders GROUP BY 1")
def json_records_source(spark, d):
    """JSON texts as sources: an object each, and arrays and `results` of two objects each."""
    from . import stages  # noqa: F401  registers the stage

    e = catalog.table(spark, d, "events").select(F.col("props").alias("content"))
    one = F.to_json(F.struct((1000 + F.col("o_orderkey") % 7).alias("k")))
    two = F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))
    o = catalog.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, two).otherwise(F.concat(F.lit('{"results":'), two, F.lit("}"))).alias("content"))
    records_ = _run(spark, d, ["JSONDataSource", {}], df=e.unionByName(o))
    return readers.json_fields(records_, {"k": "bigint"}).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    e = catalog.table(spark, d, "events").select(F.col("event_id"), F.col("props").alias("content"))
    v = F.try_parse_json("content")
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS title, o_orderstatus || ',' || o_orderpriority AS tags, CAST(o_custkey AS VARCHAR) AS authors FROM orders")
def endnote_parse(spark, d):
    o = catalog.table(spark, d, "orders")
    t = F.concat(F.lit("%T "), F.col("o_orderkey").cast("string"), F.lit("\n%A "), F.col("o_custkey").cast("string"), F.lit("\n%K "), "o_orderstatus", F.lit(";"), "o_orderpriority", F.lit("\n\n"))
    f = readers.endnote(o.select(t.alias("content")))
    return f.select(F.array_join(F.col("fields")["title"], ",").alias("title"), F.array_join(F.col("fields")["tags"], ",").alias("tags"), F.array_join(F.col("fields")["authors"], ",").alias("authors"))


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(CAST(n_nationkey AS VARCHAR), '1') OR contains(n_name, '1') OR contains(CAST(n_regionkey AS VARCHAR), '1')")
def any_cell(spark, d):
    return readers.any_cell_contains(catalog.table(spark, d, "nation"), "1").select("n_nationkey", "n_name")
