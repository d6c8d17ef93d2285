"""A stored inverted index of keywords, and boolean queries as merges of its postings.

Postings are rows (term, id), each once, in buckets by id: a bucket is a range of
documents whose file is ordered by term and then by id, where ids are stored as
differences. A query reads the pages of its terms only (equality and prefixes
are pushed down to the files, whose statistics are ordered like them), and merges
the postings of a document by one aggregation that needs no shuffle, as all of
a document's postings are in one bucket. The dictionary (term, n), in order, is
for prefixes and frequencies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.keywords import And, Word, parse

BUCKET_BYTES = 16 << 20  # of keywords
MOST_BUCKETS = 50_000  # Spark allows twice as many; beyond, buckets grow


def buckets_for(size: int) -> int:
    return min(MOST_BUCKETS, max(1, -(-size // BUCKET_BYTES)))


def _leaves(tree) -> list[Word]:
    if isinstance(tree, Word):
        return [tree]
    return list(dict.fromkeys(w for p in tree.parts for w in _leaves(p)))


def _holds(tree, names: dict) -> Column:
    if isinstance(tree, Word):
        return F.col(names[tree])
    out = None
    for part in tree.parts:
        c = _holds(part, names)
        out = c if out is None else (out & c if isinstance(tree, And) else out | c)
    return out


class Index:
    """The index stored below a path."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        made = spark.read.parquet(f"{path}/about").first()
        self.buckets, self.table = made["buckets"], f"postings_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (term STRING, id {made['kind']}) USING parquet CLUSTERED BY (id) SORTED BY (term, id) INTO {self.buckets} BUCKETS LOCATION '{path}/postings'")

    @classmethod
    def build(cls, rows: DataFrame, path: str, buckets: int | None = None) -> "Index":
        """rows: (id, keywords); buckets: where the keywords' size is known already, see buckets_for. Null ids, null arrays and null elements have no postings; an id that comes twice counts once."""
        spark = rows.sparkSession
        pairs = rows.where("id IS NOT NULL").select(F.explode("keywords").alias("term"), "id").where("term IS NOT NULL")
        if not buckets:
            size = rows.agg(F.sum(F.aggregate("keywords", F.lit(0).cast("long"), lambda n, w: n + F.coalesce(F.octet_length(w), F.lit(0)) + 8))).first()[0]
            buckets = buckets_for(size or 0)
        kind, name = rows.schema["id"].dataType.simpleString(), f"postings_{uuid.uuid4().hex}"
        # deltas of ids in place of a dictionary of them; terms, which repeat, keep theirs
        stored = pairs.repartition(buckets, "id").distinct().write.option("path", f"{path}/postings").option("parquet.writer.version", "v2").option("parquet.enable.dictionary#id", "false")
        stored.bucketBy(buckets, "id").sortBy("term", "id").saveAsTable(name)
        counts = spark.table(name).groupBy("term").agg(F.count("*").alias("n"))
        counts.orderBy("term").write.parquet(f"{path}/terms")
        spark.sql(f"DROP TABLE {name}")  # its files stay: the table is external
        spark.createDataFrame([(buckets, kind)], "buckets int, kind string").coalesce(1).write.parquet(f"{path}/about")
        return cls(spark, path)

    def terms(self, prefix: str = "") -> DataFrame:
        """(term, n): the part of the dictionary that begins with prefix, n documents having the term."""
        found = self.spark.read.parquet(f"{self.path}/terms")
        return found.where(F.startswith("term", F.lit(prefix))) if prefix else found

    def postings(self, words) -> DataFrame:
        """(term, id) of the terms that are among the words, or begin with one that is a prefix."""
        exact = [w.text for w in words if not w.prefix]
        test = F.col("term").isin(*exact) if exact else None
        for w in words:
            if w.prefix:
                c = F.startswith("term", F.lit(w.text))
                test = c if test is None else test | c
        return self.spark.table(self.table).where(test)

    def find(self, query: str) -> DataFrame:
        """(id,) of the documents whose keywords meet the query; for an empty one all that have a keyword."""
        tree = parse(query)
        if tree is None:
            return self.spark.table(self.table).select("id").distinct()
        words = _leaves(tree)
        if len(words) == 1 and not words[0].prefix:
            return self.postings(words).select("id")  # each id once
        names = {w: f"w{i}" for i, w in enumerate(words)}
        meets = [F.bool_or(F.startswith("term", F.lit(w.text)) if w.prefix else F.col("term") == w.text).alias(names[w]) for w in words]
        return self.postings(words).groupBy("id").agg(*meets).where(_holds(tree, names)).select("id")
