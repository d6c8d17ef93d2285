"""Queries of sinks, maintenance, outside services and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..operators import bibliography, external, library, snapshots
from ..sources import readers
from . import search as S
from .registry import BRIDGE, register

Q: dict = {}
query = register(Q)


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey >= 5 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_nationkey < 5 UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier")
def upsert_snapshot(spark, d):
    c = catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey")
    s = catalog.table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("name"))
    new = c.where("c_nationkey < 5").select("id", F.upper("name").alias("name")).union(s)
    return snapshots.upsert(c.select("id", "name"), new)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def delete_anti(spark, d):
    gone = catalog.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return snapshots.delete(catalog.table(spark, d, "orders").select("o_orderkey"), gone, "o_orderkey")


@query("WITH f AS (SELECT DISTINCT 'corpus/' || lang || '/' || source AS path FROM documents) SELECT path, path NOT IN (SELECT 'corpus/' || lang || '/' || source FROM documents WHERE length(text) > 8000) AS offline FROM f")
def sync_sources_offline(spark, d):
    here = catalog.paragraphs(spark, d).where("n > 8000").select(F.col("source").alias("path"))
    return snapshots.mark_offline(catalog.files(spark, d).select("path"), here)


@query(f"WITH {BRIDGE}, x AS (SELECT DISTINCT dataset AS name FROM b UNION ALL SELECT 'empty--' || n_name FROM nation) SELECT name FROM x WHERE name NOT IN (SELECT dataset FROM b)")
def unused_dataset_anti(spark, d):
    names = catalog.datasets(spark, d).select("name").union(catalog.table(spark, d, "nation").select(F.concat(F.lit("empty--"), "n_name")))
    return snapshots.unused_datasets(names, catalog.file_datasets(spark, d))


@query("SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'kept' ELSE 'src' || regexp_extract(source, 'src(1\\d)', 1) END AS author FROM documents WHERE lang = 'en' OR regexp_matches(source, 'src(1\\d)') UNION ALL SELECT doc_id, NULL FROM documents WHERE lang <> 'en' AND NOT regexp_matches(source, 'src(1\\d)')".replace("\\\\", "\\"))
def author_from_path(spark, d):
    p = catalog.paragraphs(spark, d).withColumn("author", F.when(F.col("lang") == "en", "kept"))
    out = snapshots.author_from_path(p, catalog.files(spark, d), r"(SRC1\d)")
    return out.select("id", "author")


@query("SELECT o_orderkey, make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) AS pdate FROM orders")
def pdate_from_path(spark, d):
    o = catalog.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    files = o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("a/b"), F.date_format("o_orderdate", "yyyy"), F.lit("/x.pdf")).alias("path"))
    p = o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("source"), F.lit(None).cast("timestamp_ntz").alias("pdate"))
    return snapshots.pdate_from_path(p, files).select("o_orderkey", "pdate")


@query("SELECT doc_id AS id FROM documents WHERE length(text) > 10 AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_pending(spark, d):
    e = catalog.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return snapshots.embedding_pending(catalog.paragraphs(spark, d), e).select("id")


@query("""WITH t AS (SELECT doc_id AS id, trim(text) AS t, length(trim(text)) AS n FROM documents), k AS (SELECT *, CAST(greatest(0, floor((n - 200) / 150.0)) AS BIGINT) AS k FROM t WHERE n > 0),
s AS (SELECT id, t, list_concat(list_transform(range(0, k + 1), lambda i: i * 150), CASE WHEN (k + 1) * 150 < n THEN [greatest(0, n - 200)] ELSE [] END) AS s FROM k)
SELECT id, CAST(generate_subscripts(s, 1) AS INTEGER) AS chunk_id, md5(substr(t, unnest(s) + 1, 200)) AS chunk FROM s""")
def chunk_windows(spark, d):
    from ..streaming.jobs import chunk_rows

    return chunk_rows(catalog.paragraphs(spark, d)).select("id", "chunk_id", F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@query("""WITH l AS (SELECT 'Ann. ' || n_name AS a, 'ann ' || lower(n_name) AS na FROM nation), r AS (SELECT 'A  ' || n_name AS b, 'a ' || lower(n_name) AS nb FROM nation UNION ALL SELECT 'ÀNN ' || n_name, 'ann ' || lower(n_name) FROM nation)
SELECT a AS "left", b AS "right", CASE WHEN na = nb THEN 'MATCH' ELSE 'POTENTIAL' END AS kind FROM l JOIN r ON string_split(na, ' ')[2:] = string_split(nb, ' ')[2:]""")
def dataset_name_merge(spark, d):
    n = catalog.table(spark, d, "nation")
    left = n.select(F.concat(F.lit("Ann. "), "n_name").alias("name"))
    right = n.select(F.concat(F.lit("A  "), "n_name").alias("name")).union(n.select(F.concat(F.lit("ÀNN "), "n_name")))
    return snapshots.same_names(left, right)


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS \"info.kind\", CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS \"info.more.k\", '[\"' || event_type || '\"]' AS tags FROM events")
def export_flat(spark, d):
    e = catalog.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    nested = e.select(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind"), F.struct(k.alias("k")).alias("more")).alias("info"), F.array("event_type").alias("tags"))
    return snapshots.export_flat(nested)


@query("SELECT conv_id AS path, turn AS page FROM conversations WHERE turn > CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END")
def resume_pages(spark, d):
    t = catalog.turns(spark, d).select(F.col("source").alias("path"), F.col("source_page").alias("page"))
    done = t.where("path % 2 = 0 and page <= 1").withColumnRenamed("page", "source_page")
    return snapshots.resume_pages(t, done)


@query(f"WITH {BRIDGE} SELECT DISTINCT CASE WHEN dataset = 'de' THEN 'german' WHEN dataset LIKE 'de--%' THEN 'german' || substr(dataset, 3) ELSE dataset END AS dataset, file_id FROM b")
def dataset_rename(spark, d):
    return snapshots.move_datasets(catalog.file_datasets(spark, d), "de", "german")


@query("SELECT doc_id AS id, md5('app' || text || 'saltsecret') AS md5, sha256('app' || CASE WHEN length(text) > 20 THEN substr(text, 1, 10) || length(text) || right(text, 10) ELSE text END || 'salt1700000000secret') AS sha256 FROM documents")
def mt_sign(spark, d):
    return catalog.paragraphs(spark, d).select("id", external.sign_md5("content", "app", "salt", "secret").alias("md5"), external.sign_sha256("content", "app", "salt", "1700000000", "secret").alias("sha256"))


@query("""SELECT conv_id AS source, turn AS source_page, to_json({'model': 'm', 'messages': [{'role': 'system', 'content': 'Be brief.'}, {'role': 'user', 'content': 'Say: ' || role}], 'temperature': 0.5, 'max_tokens': 100}) AS request FROM conversations""")
def llm_payload(spark, d):
    t = catalog.turns(spark, d).withColumn("ask", external.prompt("Say: {author}"))
    return t.select("source", "source_page", external.chat_request("ask", "m", "Be brief.", 0.5, 100).alias("request"))


@query("""SELECT doc_id AS id, to_json({'search': lang, 'queryType': 'simple', 'top': 10, 'select': 'a,b'}) AS azure, 'q=' || lang || '&size=10&return=a,b' AS aws FROM documents""")
def search_query_payload(spark, d):
    p = catalog.paragraphs(spark, d)
    return p.select("id", external.search_request("lang", ["a", "b"]).alias("azure"), external.search_request("lang", ["a", "b"], "aws").alias("aws"))


@query(None)
def embed_fake(spark, d):
    from ..streaming.jobs import chunk_rows

    return external.embed(chunk_rows(catalog.paragraphs(spark, d)), external.hashing_encoder(16)).select("id", "chunk_id", "embedding")


@query("SELECT doc_id AS id, CAST(length(text) AS DOUBLE) AS score FROM documents ORDER BY score DESC, id LIMIT 50")
def rerank_fake(spark, d):
    return external.rerank(catalog.paragraphs(spark, d).select("id", "content"), "q", lambda pairs: [len(c) for _, c in pairs], 50).select("id", "score")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_daily_windows(spark, d):
    """An extension: day windows, the same plan batch and streamed."""
    from ..streaming.jobs import daily_counts

    return daily_counts(catalog.table(spark, d, "events")).withColumn("total", F.round("total", 4))


# filters, counters and bibliography over whole tables


@query("SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (1, 5, 9, 200, -3, 99999999)")
def ids_filter(spark, d):
    return S.search(S.Tables(catalog.paragraphs(spark, d)), S.Filters(ids=(1, 5, 9, 200, -3, 99999999))).select("id", "lang")


@query("SELECT conv_id AS source, turn AS source_page, text AS content FROM conversations WHERE turn = 2 AND role IN ('user', 'system')")
def source_page_filter(spark, d):
    return S.search(S.Tables(catalog.turns(spark, d)), S.Filters(source_page=2, authors=("user", "system"))).select("source", "source_page", "content")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
def visible_rows(spark, d):
    """A customer's segment stands for who made the row, a negative balance for a shared one."""
    c = catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("creator"), (F.col("c_acctbal") < 0).alias("shared"))
    return S.visible(c, "BUILDING").select("id", "name")


@query("SELECT role AS author, count(*) AS n FROM conversations GROUP BY role")
def counter_author(spark, d):
    from . import stages  # noqa: F401
    from .pipeline import compile_pipeline

    return compile_pipeline(catalog.turns(spark, d), [["Counter", {"key": "author"}]])


@query("SELECT path, size_bytes FROM (SELECT 'corpus/' || lang || '/' || source AS path, sum(strlen(text)) AS size_bytes FROM documents GROUP BY 1) WHERE contains(lower(regexp_extract(path, '[^/]*$')), 'src') AND contains(lower(regexp_extract(path, '[^/]*$')), '1')")
def file_search(spark, d):
    return readers.find_files(catalog.files(spark, d), "SRC 1").select("path", "size_bytes")


@query(r"SELECT doc_id AS id, CAST(len(c) AS INTEGER) AS n, md5(array_to_string(c, '|')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '(?s).{1,500}$|.{0,499}[.!?。！？\n]|.{1,500}') AS c FROM documents)")
def chunks_for_services(spark, d):
    c = catalog.paragraphs(spark, d).select("id", external.split_chunks("content", 500).alias("c"))
    return c.select("id", F.size("c").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))


def _items(spark, d):
    c = catalog.table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("id"), F.col("c_name").alias("title"), F.when(k % 3 == 0, F.concat(F.lit("10.1/"), k)).alias("doi"), F.when(k % 3 == 1, F.lit("cat")).alias("library_catalog"),
        F.when(k % 3 == 1, F.concat(F.lit("QA"), k)).alias("call_number"), F.concat(F.lit("http://x/"), k).alias("url"), F.array(F.concat(F.lit("f"), k)).alias("file_attachments"),
    )


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n FROM customer) SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 2 = 0 THEN upper(n) ELSE n END AS title, CASE WHEN k % 2 = 0 THEN 'f' || k || '|' || 'g' || k ELSE 'f' || k END AS files FROM c
UNION ALL SELECT 'new' || s_suppkey, s_name, 'h' FROM supplier""")
def bib_save(spark, d):
    """Records found again by DOI, by catalogue and call number, or by URL; the suppliers are new."""
    old = _items(spark, d)
    again = old.where("cast(id AS long) % 2 = 0").select(F.concat(F.lit("other"), "id").alias("id"), F.upper("title").alias("title"), "doi", "library_catalog", "call_number", F.when(F.col("doi").isNull() & F.col("call_number").isNull(), F.col("url")).alias("url"), F.array(F.concat(F.lit("g"), "id")).alias("file_attachments"))
    none = F.lit(None).cast("string")
    s = catalog.table(spark, d, "supplier").select(F.concat(F.lit("new"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), none.alias("doi"), none.alias("library_catalog"), none.alias("call_number"), none.alias("url"), F.array(F.lit("h")).alias("file_attachments"))
    return bibliography.save_items(old, again.unionByName(s)).select("id", "title", F.array_join("file_attachments", "|").alias("files"))


@query("SELECT 'k' || c_custkey AS cite_key, 'article' AS entry_type, replace(c_name, '#', '\\#') AS title, c_mktsegment || ' and B' AS authors, CAST(c_nationkey AS VARCHAR) AS volume FROM customer".replace("\\\\", "\\"))
def bibtex_roundtrip(spark, d):
    """Written as BibTeX and read back; special characters stay escaped."""
    c = catalog.table(spark, d, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("key"), F.lit("article").alias("kind"), F.col("c_name").alias("title"), F.array("c_mktsegment", F.lit("B")).alias("authors"), F.col("c_nationkey").alias("volume"), F.lit("").alias("note"))
    back = bibliography.parse_bibtex(bibliography.to_bibtex(c, "key", "kind", ["title", "authors", "volume", "note"]), "bibtex")
    return back.select("cite_key", "entry_type", *[F.col("fields")[x].alias(x) for x in ("title", "authors", "volume")])


@query("""SELECT 'Z' || o_orderkey AS id, 'T ' || o_orderkey AS title, o_orderpriority || ', A & Lab' AS author, date_trunc('month', o_orderdate) AS pdate, CASE WHEN o_orderkey % 2 = 0 THEN 'J' ELSE 'Abbr' END AS publication, 'de' AS language FROM orders WHERE o_orderkey % 5 <> 0""")
def zotero_mapping(spark, d):
    """Items of a reference library as JSON; a fifth of them has no title."""
    o = catalog.table(spark, d, "orders")
    k = F.col("o_orderkey")
    person = lambda **f: F.struct(*[v.alias(n) for n, v in f.items()])
    none = F.lit(None).cast("string")
    people = F.array(person(creatorType=F.lit("author"), firstName=F.lit("A"), lastName=F.col("o_orderpriority"), name=none), person(creatorType=F.lit("author"), firstName=none, lastName=none, name=F.lit("Lab")))
    data = F.struct(
        F.when(k % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" T "), k)).alias("title"), F.date_format("o_orderdate", "yyyy-MM").alias("date"), F.when(k % 2 == 0, "J").alias("publicationTitle"),
        F.lit("Abbr").alias("journalAbbreviation"), F.lit("de").alias("language"), people.alias("creators"),
    )
    items = o.select(F.to_json(F.struct(F.concat(F.lit("Z"), k).alias("key"), data.alias("data"))).alias("content"))
    return readers.zotero_items(items).select("id", "title", "author", F.col("pdate").cast("timestamp_ntz").alias("pdate"), "publication", "language")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN 'new/' ELSE 'old/' END || c_custkey AS path, c_nationkey < 5 AS moved FROM customer")
def moved_books(spark, d):
    c = catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("lib").alias("library_catalog"), F.col("c_custkey").cast("string").alias("call_number"), F.concat(F.lit("old/"), "c_custkey").alias("path"), "c_nationkey")
    books = c.where("c_nationkey < 10").select("library_catalog", "call_number", F.when(F.col("c_nationkey") < 5, F.concat(F.lit("new/"), "call_number")).otherwise(F.col("path")).alias("path"))
    return library.moved(c.drop("c_nationkey"), books).select("id", "path", "moved")
