"""Declarative search: one DataFrame from filters, keywords or a vector, groups, order and page."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.vectors import nearest_per_record
from .keywords import matches


@dataclass(frozen=True)
class Filters:
    """What to search for. Empty and zero mean no restriction."""

    q: str = ""
    ids: tuple = ()
    datasets: tuple = ()
    sources: tuple = ()
    source_page: int = 0
    outlines: tuple = ()
    langs: tuple = ()
    authors: tuple = ()
    has_embedding: bool | None = None
    vector: tuple = ()
    group_by: str = ""
    sort: str = ""
    offset: int = 0
    limit: int = 0
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Tables:
    paragraphs: DataFrame
    files: DataFrame | None = None
    file_datasets: DataFrame | None = None  # dataset, file_id
    embeddings: DataFrame | None = None  # id, source, chunk_id, embedding
    index: object = None  # an operators.inverted.Index of the paragraphs' keywords: queries then read no text and no keywords
    encoder: object = None  # text -> vector, for queries that begin with a colon; see QueryEncoder


class QueryEncoder:
    """The caller's encode(list of texts) -> vectors for one query at a time, remembered for a while after its last use."""

    def __init__(self, encode, ttl: float = 600.0, most: int = 10_000, clock=time.monotonic):
        self.encode, self.ttl, self.most, self.clock = encode, ttl, most, clock
        self.held: dict[str, tuple[float, tuple]] = {}

    def __call__(self, text: str) -> tuple:
        now = self.clock()
        at, vector = self.held.pop(text, (None, None))
        if at is None or now - at > self.ttl:
            (vector,) = (tuple(map(float, v)) for v in self.encode([text]))
        self.held[text] = now, vector  # used last, forgotten last
        while len(self.held) > self.most:
            del self.held[next(iter(self.held))]
        return vector


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def below(column: str, names, separator: str) -> Column:
    """The name itself, or one that goes on after it with the separator; case is ignored below."""
    c = F.col(column)
    return reduce(lambda a, b: a | b, [c.ilike(_escaped(n + separator) + "%") for n in names], c.isin(*names))


def predicate(text: str) -> Column:
    """A boolean SQL expression over a row. Subqueries are refused."""
    if "select" in text.lower().split("(") or " select " in f" {text.lower()} ".replace("(", " "):
        raise ValueError("a predicate must not hold a query")
    return F.coalesce(F.expr(text).cast("boolean"), F.lit(False))


def filtered(t: Tables, f: Filters) -> DataFrame:
    """The rows that pass every filter but the vector; each once, however many data sets its file is in."""
    df = t.paragraphs
    if f.ids:
        df = df.where(F.col("id").isin(*f.ids))
    if f.datasets:
        files = t.file_datasets.where(below("dataset", f.datasets, "--")).select(F.col("file_id").alias("source"))
        df = df.join(files, "source", "left_semi")
    if f.sources:
        files = t.files.where(below("path", f.sources, "")).select(F.col("id").alias("source"))
        df = df.join(files, "source", "left_semi")
    if f.source_page:
        df = df.where(F.col("source_page") == f.source_page)
    for column, values in (("outline", f.outlines), ("lang", f.langs), ("author", f.authors)):
        if values:
            df = df.where(F.col(column).isin(*values))
    if f.has_embedding is not None:
        df = df.join(t.embeddings.select("id").distinct(), "id", "left_semi" if f.has_embedding else "left_anti")
    q = f.q.strip()
    if q.startswith("?"):
        return df.where(predicate(q[1:]))
    if q.startswith("*"):
        inner = q.strip("*")
        return df.where(F.col("content").ilike(f"%{inner}%")) if inner else df
    if q and not q.startswith(":"):
        return df.join(t.index.find(q), "id", "left_semi") if t.index is not None else df.where(matches(q))
    return df


PATH = "__path"  # the path of a row's file, while rows are ordered by it


def _with_path(t: Tables, df: DataFrame, sort: str) -> DataFrame:
    """df with the path of its file, where the order asks for it and files are known; a row of an unknown file has none."""
    if t.files is None or "source" not in [k.strip().lstrip("+-") for k in sort.split(",")]:
        return df
    paths = t.files.select(F.col("id").alias("source"), F.col("path").alias(PATH))
    return df.join(paths, "source", "left").select(*df.columns, PATH)


def datasets_of(t: Tables, rows: DataFrame) -> DataFrame:
    """rows with `datasets`, the sorted names of the data sets their file is in; empty without a file or data set."""
    names = t.file_datasets.groupBy(F.col("file_id").alias("source")).agg(F.array_sort(F.collect_set("dataset")).alias("datasets"))
    return rows.drop("datasets").join(names, "source", "left").withColumn("datasets", F.coalesce("datasets", F.array().cast("array<string>")))


def files_of(t: Tables, *datasets: str) -> DataFrame:
    """Each file of the data sets and of those below them, once."""
    return t.files.join(t.file_datasets.where(below("dataset", datasets, "--")).select(F.col("file_id").alias("id")), "id", "left_semi")


def order(df: DataFrame, sort: str, *tie) -> list[Column]:
    """"a,-b" as columns: nulls last upwards and first downwards; unknown names are left out; ties by `tie`."""
    out = []
    for key in filter(None, (k.strip() for k in sort.split(","))):
        name = key.lstrip("+-")
        names = [PATH if PATH in df.columns else "source", "source_page"] if name == "source" else [name]
        for n in names:
            if n in df.columns:
                out.append(F.col(n).desc_nulls_first() if key.startswith("-") else F.col(n).asc_nulls_last())
    return out + [F.col(c).asc_nulls_last() for c in tie if c in df.columns]


def distinct_on(df: DataFrame, column: str, sort: str = "") -> DataFrame:
    """The first row of each value of the column."""
    w = Window.partitionBy(column).orderBy(*order(df, sort, "id"))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def search(t: Tables, f: Filters) -> DataFrame:
    """The page of results. With a vector, or a text after a colon and an encoder: nearest first, `distance` added."""
    if f.q.strip().startswith(":") and not f.vector:
        if t.encoder is None:
            raise ValueError("a search for a meaning needs an encoder or a vector")
        f = replace(f, vector=tuple(t.encoder(f.q.strip()[1:].strip())))
    df = filtered(t, f)
    columns = df.columns + (["distance"] if f.vector else [])
    df = df if f.vector else _with_path(t, df, f.sort)
    if f.vector:
        near = nearest_per_record(t.embeddings, list(f.vector))
        df = df.join(near.drop("chunk_id"), [c for c in ("id", "source") if c in near.columns])
        keys = [F.col("distance"), F.col("id")]
    else:
        if f.group_by and f.group_by in df.columns:
            df = distinct_on(df, f.group_by, f.sort)
        keys = order(df, f.sort, "id")
    if f.sort or f.vector or f.offset or f.limit:
        df = df.orderBy(*keys)
    if f.offset:
        df = df.offset(f.offset)
    df = df.limit(f.limit) if f.limit else df
    return df.select(*columns) if PATH in df.columns else df


def count(t: Tables, f: Filters) -> DataFrame:
    return search(t, replace(f, offset=0, limit=0, sort="")).agg(F.count("*").alias("n"))


def facet(t: Tables, f: Filters, column: str) -> DataFrame:
    """(column, n): counts without the query and without the column's own filter."""
    own = {"lang": "langs", "author": "authors", "outline": "outlines", "source": "sources"}.get(column)
    df = filtered(t, replace(f, q="", **({own: ()} if own else {})))
    return df.groupBy(column).agg(F.count("*").alias("n"))


def hierarchy(datasets: DataFrame) -> DataFrame:
    """(path, depth, n, order_weight): every node of the tree of names joined by "--", with the data sets at or below it."""
    parts = F.split("name", "--")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "--").alias("path")))
    return datasets.select("order_weight", F.explode(nodes).alias("x")).groupBy("x.path", "x.depth").agg(F.count("*").alias("n"), F.min("order_weight").alias("order_weight"))


def terms_with_prefix(terms: DataFrame, prefix: str) -> DataFrame:
    """The vocabulary's terms that begin with a prefix, in order."""
    return terms.where(F.startswith("term", F.lit(prefix.lower()))).orderBy("term")


def visible(rows: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """Rows that a user may see: all for an administrator, else own and shared ones (columns creator, shared)."""
    return rows if admin else rows.where((F.col("creator") == user) | F.coalesce(F.col("shared"), F.lit(False)))


def history(spark, user: str, f: Filters) -> DataFrame:
    """One row to append to the query log: user, the filters as JSON, the time."""
    import json
    from dataclasses import asdict

    return spark.range(1).select(F.lit(user).alias("user"), F.lit(json.dumps(asdict(f), sort_keys=True)).alias("queries"), F.current_timestamp().alias("created_at"))


def page(t: Tables, f: Filters) -> tuple[DataFrame, DataFrame]:
    """(total, rows): the number of all results and the page asked for."""
    return count(t, f), search(t, f)
