"""Queries of the search surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog, folders
from ..operators import inverted
from ..operators.bibliography import search_items
from . import search as S
from .registry import BRIDGE, PARAGRAPHS, PLAIN, register

Q: dict = {}
query = register(Q)


def index_of(spark, d):
    """The stored keyword index of the paragraphs; an application builds it once for each data folder."""

    def build(path):
        size = catalog.table(spark, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
        inverted.Index.build(catalog.paragraphs(spark, d, True).select("id", "keywords"), path, inverted.buckets_for(4 * size))

    path = folders.once(spark, ("keywords", d), build)
    return inverted.Index(spark, path)


def _tables(spark, d, keywords=True):
    e = catalog.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id").withColumn("chunk_id", F.lit(1))
    return S.Tables(catalog.paragraphs(spark, d), catalog.files(spark, d), catalog.file_datasets(spark, d), e, index_of(spark, d) if keywords else None)


def _found(spark, d, keywords=True, **f):
    return S.search(_tables(spark, d, keywords), S.Filters(**f)).select("id", "lang", "n")


@query(f"WITH {PARAGRAPHS} SELECT id, lang, n FROM p WHERE list_contains(keywords, 'the') AND list_contains(keywords, 'and')")
def kw_and(spark, d):
    return _found(spark, d, q="the & and")


@query(f"WITH {PARAGRAPHS} SELECT id, lang, n FROM p WHERE (list_contains(keywords, 'the') OR list_contains(keywords, 'der')) AND list_contains(keywords, 'in')")
def kw_or_paren(spark, d):
    return _found(spark, d, q="(the | der) in")


@query(f"WITH {PARAGRAPHS} SELECT lang, count(*) AS n FROM p WHERE (list_contains(keywords, 'the') OR list_contains(keywords, 'der')) AND len(list_filter(keywords, lambda k: starts_with(k, 'un'))) > 0 GROUP BY lang")
def kw_prefix(spark, d):
    t = _tables(spark, d)
    return S.search(t, S.Filters(q="(the|der) & ^un")).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {PARAGRAPHS} SELECT id, lang, n FROM p WHERE list_contains(keywords, 'la') AND list_contains(keywords, 'de')")
def kw_implicit_and(spark, d):
    return _found(spark, d, q="LA de")


@query(f"WITH {PLAIN} SELECT id, lang, n FROM p WHERE content ILIKE '%tion the%'")
def content_ilike(spark, d):
    return _found(spark, d, False, q="*tion the*")


@query(f"WITH {PLAIN} SELECT id, lang, n FROM p WHERE n > 3000 AND lang <> 'en'")
def expr_filter(spark, d):
    return _found(spark, d, False, q="?n > 3000 and lang <> 'en'")


@query(f"WITH {PLAIN} SELECT id, lang, n FROM p WHERE lang IN ('de', 'fr')")
def lang_in(spark, d):
    return _found(spark, d, False, langs=("de", "fr"))


@query(f"WITH {PLAIN} SELECT id, lang, n FROM p WHERE source ILIKE 'corpus/en/src1%'")
def source_prefix(spark, d):
    return _found(spark, d, False, sources=("corpus/en/src1",))


@query(f"WITH {PLAIN}, {BRIDGE} SELECT id, lang, n FROM p WHERE source IN (SELECT file_id FROM b WHERE dataset IN ('de', 'en--src3') OR dataset ILIKE 'de--%' OR dataset ILIKE 'en--src3--%')")
def dataset_subtree(spark, d):
    return _found(spark, d, False, datasets=("de", "en--src3"))


@query(f"WITH {PLAIN} SELECT id, lang, n FROM p WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = p.id)")
def no_embedding_anti(spark, d):
    return _found(spark, d, False, has_embedding=False)


@query(f"WITH {PLAIN}, {BRIDGE} SELECT lang, count(*) AS n FROM p WHERE source IN (SELECT file_id FROM b WHERE dataset ILIKE 'en--%' OR dataset = 'fr') GROUP BY lang")
def facet_lang(spark, d):
    return S.facet(_tables(spark, d, False), S.Filters(q="the", langs=("en",), datasets=("en", "fr")), "lang")


@query(f"WITH {PLAIN} SELECT source, count(*) AS n FROM p WHERE lang = 'en' GROUP BY source")
def facet_source(spark, d):
    return S.facet(_tables(spark, d, False), S.Filters(q="the", langs=("en",)), "source")


@query(f"WITH {PLAIN} SELECT DISTINCT ON (lang) id, lang, n FROM p ORDER BY lang, n DESC, id")
def distinct_on_lang(spark, d):
    return _found(spark, d, False, group_by="lang", sort="-n")


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS seg, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
SELECT id, row_number() OVER (ORDER BY seg ASC NULLS LAST, bal DESC NULLS FIRST, id) AS place FROM c ORDER BY place LIMIT 500""")
def sort_multi_nulls(spark, d):
    from pyspark.sql import Window

    c = catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    keys = S.order(c, "seg,-bal,unknown", "id")
    top = c.orderBy(*keys).limit(500)  # the report is a page of 500
    return top.select("id", F.row_number().over(Window.orderBy(*keys)).alias("place"))


@query(f"WITH {PLAIN} SELECT id, lang, n FROM p ORDER BY lang ASC, n DESC, id LIMIT 20 OFFSET 40")
def page_offset_limit(spark, d):
    return _found(spark, d, False, sort="lang,-n", offset=40, limit=20)


@query(f"WITH {PLAIN} SELECT id, lang, n FROM p ORDER BY source DESC, id LIMIT 30 OFFSET 10")
def sort_source_path(spark, d):
    """A page in the order of the files' paths; the rows know their files by hashes only."""
    t = _tables(spark, d, False)
    hashed = S.Tables(t.paragraphs.withColumn("source", F.md5("source")), t.files.withColumn("id", F.md5("path")))
    return S.search(hashed, S.Filters(sort="-source", offset=10, limit=30)).select("id", "lang", "n")


@query(f"WITH {PLAIN}, {BRIDGE} SELECT id, (SELECT string_agg(dataset, '|' ORDER BY dataset) FROM b WHERE file_id = source) AS datasets FROM p")
def paragraph_datasets(spark, d):
    t = _tables(spark, d, False)
    return S.datasets_of(t, t.paragraphs).select("id", F.array_join("datasets", "|").alias("datasets"))


@query(f"WITH {BRIDGE} SELECT DISTINCT file_id AS path FROM b WHERE dataset = 'en' OR starts_with(dataset, 'en--') OR dataset = 'de--web'")
def dataset_files(spark, d):
    return S.files_of(_tables(spark, d, False), "en", "de--web").select("path")


@query(f"WITH {PARAGRAPHS} SELECT lang, min(id) AS id FROM p WHERE list_contains(keywords, 'the') GROUP BY lang")
def db_query_source(spark, d):
    """A stored pipeline that starts with a search."""
    from . import stages  # noqa: F401  registers the stages
    from .pipeline import Context, compile_pipeline

    t = _tables(spark, d)
    steps = [["DBQueryDataSource", {"query": "the", "groups": "lang", "sort": "lang"}]]
    return compile_pipeline(spark.range(1), steps, Context(named={"paragraphs": t.paragraphs, "keyword_index": t.index})).select("lang", "id")


@query(f"WITH {PARAGRAPHS} SELECT term, count(DISTINCT id) AS n FROM (SELECT unnest(keywords) AS term, id FROM p) GROUP BY term HAVING starts_with(term, 'th') OR count(DISTINCT id) = 1")
def keyword_dictionary(spark, d):
    """Terms with a prefix, and those of one document, with their numbers of documents."""
    index = index_of(spark, d)
    return index.terms("th").unionAll(index.terms().where("n = 1 AND NOT startswith(term, 'th')"))


@query(f"WITH {PARAGRAPHS} SELECT count(*) AS n FROM p WHERE list_contains(keywords, 'the')")
def count_total(spark, d):
    return S.count(_tables(spark, d), S.Filters(q="the", limit=5))


@query(f"""WITH {BRIDGE}, n AS (SELECT DISTINCT dataset AS name FROM b), x AS (SELECT unnest(range(1, len(string_split(name, '--')) + 1)) AS k, string_split(name, '--') AS s FROM n)
SELECT array_to_string(list_slice(s, 1, k), '--') AS path, CAST(k AS INTEGER) AS depth, count(*) AS n, 999 AS order_weight FROM x GROUP BY 1, 2""")
def hierarchy_counts(spark, d):
    return S.hierarchy(catalog.datasets(spark, d))


@query("""SELECT c_custkey, c_name FROM customer WHERE (c_name ILIKE '%7%' OR c_mktsegment ILIKE '%7%') AND (c_name ILIKE '%build%' OR c_mktsegment ILIKE '%build%')""")
def bib_all_fields(spark, d):
    return search_items(catalog.table(spark, d, "customer"), "7 build", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


_QUESTION = "The rate of the other thing, and what it is for"
_ABC = "abcdefghijklmnopqrstuvwxyz"


def _letters(texts):
    """A stand-in for an encoder that SQL can have too: how often each letter comes."""
    return [[float(t.lower().count(x)) for x in _ABC] for t in texts]


@query(f"""WITH v AS (SELECT doc_id AS id, lang, list_transform(string_split('{_ABC}', ''), lambda x: CAST(length(text) - length(replace(text, x, '')) AS DOUBLE)) AS v FROM (SELECT doc_id, lang, lower(text) AS text FROM documents)),
d AS (SELECT id, round(1 - list_cosine_similarity(v, {_letters([_QUESTION])[0]}), 9) AS distance FROM v WHERE lang IN ('en', 'de') AND list_sum(v) > 0) SELECT id, round(distance, 6) AS distance FROM d ORDER BY d.distance, id LIMIT 25""")
def semantic_text(spark, d):
    """A search for a text's meaning, within two languages; the query's vector comes from the encoder."""
    p = catalog.paragraphs(spark, d)
    low = F.lower("content")
    vector = F.array(*[(F.char_length(low) - F.char_length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in _ABC])
    e = p.select("id", "source", F.lit(0).alias("chunk_id"), vector.alias("embedding"))
    t = S.Tables(p, embeddings=e, encoder=S.QueryEncoder(_letters))
    found = S.search(t, S.Filters(q=f": {_QUESTION}", langs=("en", "de")))
    return found.select("id", F.round("distance", 9).alias("d")).orderBy("d", "id").limit(25).select("id", F.round("d", 6).alias("distance"))


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM e WHERE id = 0), d AS (SELECT doc_id AS id FROM documents)
SELECT id, round(1 - list_cosine_similarity(e.v, q.v), 6) AS distance FROM e, q WHERE id IN (SELECT id FROM d) ORDER BY 1 - list_cosine_similarity(e.v, q.v), id LIMIT 25""")
def semantic_search(spark, d):
    t = _tables(spark, d, False)
    vector = t.embeddings.where("id = 0").first().embedding
    return S.search(t, S.Filters(vector=tuple(vector), limit=25)).select("id", F.round("distance", 6).alias("distance"))
