"""Queries of reducers, bibliography and the library star."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import text
from ..operators import bibliography, counts, library
from .registry import LOW, TOKENS, register

Q: dict = {}
query = register(Q)


def _low(spark, d):
    return catalog.paragraphs(spark, d).select("id", "lang", text.words(F.lower("content")).alias("tokens"))


_CH = """ch AS MATERIALIZED (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, '') AS l FROM documents WHERE text <> '')),
w AS MATERIALIZED (SELECT doc_id, i, x, coalesce(lag(x, 1) OVER o, ' ') AS x1, coalesce(lag(x, 2) OVER o, ' ') AS x2, coalesce(lag(x, 3) OVER o, ' ') AS x3 FROM ch WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""


@query(f"WITH {_CH} SELECT gram, count(*) AS n FROM (SELECT x AS gram FROM w UNION ALL SELECT x1 || x FROM w UNION ALL SELECT x2 || x1 || x FROM w) GROUP BY gram")
def ngram_counts(spark, d):
    return counts.ngrams(catalog.paragraphs(spark, d), 3)


@query(f"""WITH {_CH}, g AS (SELECT x2 AS l, x1 AS word, x AS r FROM w UNION ALL SELECT x3, x2 || x1, x FROM w)
SELECT 'left' AS side, word, l AS char, count(*) AS n FROM g GROUP BY 2, 3 UNION ALL SELECT 'right', word, r, count(*) FROM g GROUP BY 2, 3""")
def ngram_left_right(spark, d):
    left, right = counts.ngram_neighbours(catalog.paragraphs(spark, d), 2)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right"))).select("side", "word", "char", "n")


@query(f"WITH {LOW}, t AS (SELECT id, unnest(tokens) AS term FROM p) SELECT term, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids FROM t GROUP BY term")
def term_freq(spark, d):
    return counts.term_freq(_low(spark, d)).select("term", "n", F.md5(F.array_join("ids", ",").cast("binary")).alias("ids"))


@query(f"""WITH {LOW}, t AS (SELECT id, unnest(tokens) AS term FROM p), c AS (SELECT term, id, count(*) AS c FROM t GROUP BY ALL), s AS (SELECT term, sum(c) AS tf, count(*) AS df FROM c GROUP BY term),
i AS (SELECT term, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY id) AS k FROM c) WHERE k <= 50 GROUP BY term)
SELECT term, CAST(tf AS BIGINT) AS tf, df, round(tf * log2((SELECT count(*) FROM documents) / df), 6) AS score, ids FROM s JOIN i USING (term)""")
def tfidf(spark, d):
    return counts.tfidf(_low(spark, d)).select("term", "tf", "df", F.round("score", 6).alias("score"), F.array_join("ids", ",").alias("ids"))


@query(f"""WITH {_CH}, g AS MATERIALIZED (SELECT gram, count(*) AS n FROM (SELECT x AS gram FROM w UNION ALL SELECT x1 || x FROM w WHERE i > 1 UNION ALL SELECT x2 || x1 || x FROM w WHERE i > 2 UNION ALL SELECT x1 || x FROM w WHERE i = 1 UNION ALL SELECT x2 || x1 || x FROM w WHERE i <= 2) WHERE gram NOT LIKE ' %' GROUP BY gram),
t AS (SELECT sum(n) AS total FROM g WHERE length(gram) = 1),
f AS (SELECT gram, n, total FROM g, t WHERE length(gram) BETWEEN 2 AND 3 AND NOT regexp_matches(gram, '[\\s.,|!#$%&*0-9]') AND n > floor(total * 0.0005)),
k AS (SELECT gram, unnest(range(1, length(gram))) AS i FROM f),
m AS (SELECT k.gram, min(coalesce(a.n, 1) * coalesce(b.n, 1)) AS p FROM k LEFT JOIN g a ON a.gram = substr(k.gram, 1, i) LEFT JOIN g b ON b.gram = substr(k.gram, i + 1) GROUP BY 1),
h AS (SELECT f.gram AS word, n, n * total / p AS ratio FROM f JOIN m USING (gram) WHERE n * total / p > 2),
q AS (SELECT x2 AS l, x1 AS word, x AS r FROM w UNION ALL SELECT x3, x2 || x1, x FROM w UNION ALL SELECT coalesce(lag(x, 4) OVER (PARTITION BY doc_id ORDER BY i), ' '), x3 || x2 || x1, x FROM w),
el AS (SELECT word, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM (SELECT word, l, count(*) AS c FROM q GROUP BY 1, 2) GROUP BY word),
er AS (SELECT word, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM (SELECT word, r, count(*) AS c FROM q GROUP BY 1, 2) GROUP BY word)
SELECT word, n, round(CAST(ratio AS DOUBLE), 4) AS ratio, round(least(el.e, er.e), 4) AS entropy FROM h JOIN el USING (word) JOIN er USING (word) WHERE least(el.e, er.e) > 1""".replace("\\\\", "\\"))
def pmi_words(spark, d):
    out = counts.pmi_words(catalog.paragraphs(spark, d), 3, 0.0005, 1.0, 1.0, stop=r"[\s.,|!#$%&*0-9]")
    return out.select("word", "n", F.round("ratio", 4).alias("ratio"), F.round("entropy", 4).alias("entropy"))


@query(f"""WITH {LOW}, t AS (SELECT id, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS term FROM p), v AS (SELECT term, row_number() OVER (ORDER BY f) - 1 AS dim FROM (SELECT term, min((id, pos)) AS f FROM t GROUP BY term)),
c AS (SELECT id, dim, count(*) AS c FROM t JOIN v USING (term) WHERE dim < 100000 GROUP BY ALL), g AS (SELECT id, string_agg(dim || ':' || c, ' ' ORDER BY dim) AS vec FROM c GROUP BY id)
SELECT id, coalesce(vec, '') AS vec FROM p LEFT JOIN g USING (id)""")
def bow_vectors(spark, d):
    b = counts.bag_of_words(_low(spark, d), 100000)
    return b.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("vec")), lambda e: F.concat_ws(":", e["key"], e["value"])), " ").alias("vec"))


# pairs of whole texts take DuckDB too long: tests/test_whole.py holds it against a count by hand
@query()
def cooccurrence_tokens(spark, d):
    return counts.cooccurrence(_low(spark, d))


@query("SELECT conv_id AS source, max(turn) AS last FROM conversations GROUP BY conv_id")
def max_page_per_source(spark, d):
    return catalog.turns(spark, d).groupBy("source").agg(F.max("source_page").alias("last"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_summary(spark, d):
    return counts.counter(catalog.table(spark, d, "events"), "event_type")


def _items(spark, d):
    p = catalog.table(spark, d, "part")
    o = F.col("p_partkey")
    return p.select(
        o.alias("id"), F.when(o % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit(" "), "p_type")).alias("title"), F.when(o % 3 > 0, F.col("p_brand")).alias("author"),
        F.when(o % 5 > 0, F.col("p_name")).alias("publisher"), F.col("p_retailprice").alias("modified"), F.array(F.when(o % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")), F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))).alias("tags"),
    )


_ITEMS = "i AS (SELECT p_partkey AS id, lower(trim(p_type)) AS k_title, CASE WHEN p_partkey % 3 > 0 THEN lower(trim(p_brand)) ELSE '' END AS k_author, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS publisher, p_retailprice AS modified, [lower(p_brand), 's' || (p_size % 3)] AS tags FROM part)"


@query(f"WITH {_ITEMS} SELECT k_title, k_author, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM i GROUP BY 1, 2 HAVING count(*) > 1")
def dedup_groups(spark, d):
    return bibliography.duplicate_groups(_items(spark, d)).withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH {_ITEMS}, t AS (SELECT k_title, k_author, unnest(tags) AS t FROM i)
SELECT g.*, s.tags FROM (SELECT k_title, k_author, min(id) AS id, count(*) AS n, first(publisher ORDER BY modified DESC, id) FILTER (publisher <> '') AS publisher FROM i GROUP BY 1, 2) g
JOIN (SELECT k_title, k_author, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM t GROUP BY 1, 2) s USING (k_title, k_author)""")
def dedup_merge_latest(spark, d):
    m = bibliography.merge_duplicates(_items(spark, d), ["publisher"], tags=["tags"])
    return m.withColumn("tags", F.array_join(F.array_sort(F.transform("tags", F.lower)), ","))


@query(f"WITH {_ITEMS}, g AS (SELECT count(*) AS n FROM i GROUP BY k_title, k_author) SELECT CAST(sum(n) AS BIGINT) AS total_before, count(*) FILTER (n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS removed, count(*) AS total_after FROM g")
def dedup_stats(spark, d):
    return bibliography.duplicate_stats(_items(spark, d))


@query(f"SELECT DISTINCT term FROM (SELECT unnest({TOKENS}) AS term FROM documents) WHERE term <> ''")
def sync_terms(spark, d):
    from ..operators.snapshots import all_terms

    return all_terms(catalog.paragraphs(spark, d, True))


@query(f"WITH t AS (SELECT DISTINCT lang, unnest({TOKENS}) AS term FROM documents) SELECT DISTINCT term FROM t WHERE length(term) > 1 AND lang <> 'en' AND term NOT IN (SELECT term FROM t WHERE lang = 'en')")
def terms_store(spark, d):
    from ..operators.snapshots import all_terms, new_terms

    p = catalog.paragraphs(spark, d, True)
    return new_terms(all_terms(p.where("lang = 'en'")), p.where("lang <> 'en'"))


_STAR = """WITH o AS (SELECT o_custkey AS k, string_agg(DISTINCT o_orderpriority, '&' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS k, string_agg(DISTINCT p_brand, '&' ORDER BY p_brand) AS brands FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT c_custkey, n_name, r_name, coalesce(priorities, '') AS priorities, coalesce(brands, '') AS brands FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN o ON o.k = c_custkey LEFT JOIN l ON l.k = c_custkey"""


@query(_STAR)
def calibre_star_join(spark, d):
    t = lambda n: catalog.table(spark, d, n)
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    bought = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    facts = t("customer").join(t("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left").join(t("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
    out = library.complete(facts, "c_custkey", {"priorities": (orders, "o_custkey", F.col("o_orderpriority")), "brands": (bought, "o_custkey", F.col("p_brand"))})
    return out.select("c_custkey", "n_name", "r_name", F.array_join("priorities", "&").alias("priorities"), F.array_join("brands", "&").alias("brands"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def calibre_filter_semi(spark, d):
    t = lambda n: catalog.table(spark, d, n)
    c = library.having(t("customer"), "c_custkey", [(t("orders"), "o_custkey", "o_orderstatus = 'F'")])
    return library.having(c, "c_nationkey", [(t("nation"), "n_nationkey", "n_regionkey = 1")]).select("c_custkey", "c_name")


@query("""WITH b AS (SELECT p_size > 25 AS cover, p_brand AS kind, p_size % 6 AS rating FROM part)
SELECT 'total' AS what, '' AS k, count(*) AS n FROM b UNION ALL SELECT 'with_cover', '', count(*) FROM b WHERE cover UNION ALL SELECT 'without_cover', '', count(*) FROM b WHERE NOT cover
UNION ALL SELECT 'kind', kind, count(*) FROM b GROUP BY kind UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), count(*) FROM b WHERE rating <> 0 GROUP BY rating""")
def calibre_stats(spark, d):
    b = catalog.table(spark, d, "part").select((F.col("p_size") > 25).alias("cover"), F.col("p_brand").alias("kind"), (F.col("p_size") % 6).alias("rating"))
    totals, kinds, ratings = library.statistics(b, "cover", "kind", "rating")
    flat = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.lit("").alias("k"), F.col(c).alias("n")) for c in totals.columns])).alias("x")).select("x.*")
    return flat.union(kinds.select(F.lit("kind"), "kind", "n")).union(ratings.select(F.lit("rating"), F.col("rating").cast("string"), "n"))


@query("SELECT conv_id AS source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_estimates(spark, d):
    from ..operators.external import token_estimate

    return catalog.turns(spark, d).groupBy("source").agg(F.sum(token_estimate("content")).alias("tokens"))
