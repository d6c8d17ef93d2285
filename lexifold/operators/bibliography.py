"""Bibliographic records: merging duplicates, upserts by identifiers, BibTeX."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def _key(c) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit(""))))


def duplicate_groups(items: DataFrame, title: str = "title", author: str = "author") -> DataFrame:
    """(k_title, k_author, n, ids): groups of more than one record with equal title and author, case and outer blanks aside."""
    g = items.groupBy(_key(title).alias("k_title"), _key(author).alias("k_author"))
    return g.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).where("n > 1")


def merge_duplicates(items: DataFrame, fields, tags=(), maps=(), keep: str = "latest", by: str = "modified", title: str = "title", author: str = "author") -> DataFrame:
    """One record for each title and author.

    Fields are those of the latest or earliest record by `by`, or the first by
    id, that has one: neither null nor empty. Tag arrays are joined, equal ones
    but for case once (the first spelling in order); maps are joined, the
    earlier record's entries first.
    """
    order = {"latest": [F.col(by).desc_nulls_last(), F.col("id")], "earliest": [F.col(by).asc_nulls_last(), F.col("id")], "first": [F.col("id")]}[keep]
    from pyspark.sql import Window

    w = Window.partitionBy("k_title", "k_author").orderBy(*order)
    rows = items.withColumn("k_title", _key(title)).withColumn("k_author", _key(author)).withColumn("__r", F.row_number().over(w))
    value = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(F.col("__r").alias("r"), F.col(c).alias("v")))
    aggs = [F.min("id").alias("id"), F.count("*").alias("n"), *[F.min(value(c))["v"].alias(c) for c in fields]]
    for c in tags:
        ordered = F.array_sort(F.collect_list(F.struct("__r", F.coalesce(c, F.array().cast("array<string>")).alias("x"))))
        flat = F.flatten(F.transform(ordered, lambda s: s["x"]))
        once = F.aggregate(flat, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))
        aggs.append(once.alias(c))
    for c in maps:
        ordered = F.array_sort(F.collect_list(F.struct("__r", F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))).alias("x"))), lambda a, b: a["__r"] - b["__r"])
        flat = F.flatten(F.transform(ordered, lambda s: s["x"]))
        once = F.aggregate(flat, F.create_map().cast("map<string,string>"), lambda acc, e: F.when(F.map_contains_key(acc, e["key"]), acc).otherwise(F.map_concat(acc, F.map_from_entries(F.array(e)))))
        aggs.append(once.alias(c))
    return rows.groupBy("k_title", "k_author").agg(*aggs)


def duplicate_stats(items: DataFrame, title: str = "title", author: str = "author") -> DataFrame:
    """(total_before, groups, removed, total_after)."""
    g = items.groupBy(_key(title).alias("t"), _key(author).alias("a")).agg(F.count("*").alias("n"))
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_before"), F.count_if(F.col("n") > 1).alias("groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"), F.count("*").alias("total_after"),
    )


def match_existing(new: DataFrame, old: DataFrame) -> DataFrame:
    """new with `match`: the id of the record it updates, by DOI, else catalogue and call number, else URL."""

    def by(columns, name):
        o = old.where(" and ".join(f"coalesce({c}, '') <> ''" for c in columns)).groupBy(*columns).agg(F.min("id").alias(name))
        return o

    out = new.join(by(["doi"], "__doi"), "doi", "left").join(by(["library_catalog", "call_number"], "__call"), ["library_catalog", "call_number"], "left").join(by(["url"], "__url"), "url", "left")
    return out.withColumn("match", F.coalesce("__doi", "__call", "__url")).drop("__doi", "__call", "__url")


def save_items(old: DataFrame, new: DataFrame, attachments: str = "file_attachments") -> DataFrame:
    """old with the records of new: matched ones updated (attachments joined), the others added."""
    found = match_existing(new, old)
    before = old.select(F.col("id").alias("match"), F.col(attachments).alias("__files"))
    found = found.join(before, "match", "left").withColumn("id", F.coalesce("match", "id"))
    empty = F.array().cast("array<string>")
    found = found.withColumn(attachments, F.array_union(F.coalesce("__files", empty), F.coalesce(attachments, empty))).select(*old.columns)
    from .snapshots import upsert

    return upsert(old, found)


def search_items(items: DataFrame, query: str, columns, arrays=()) -> DataFrame:
    """Records in which each blank-separated token is part of some column or array, any case."""
    out = items
    for token in query.split():
        like = "%" + token.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        test = F.lit(False)
        for c in columns:
            test = test | F.coalesce(F.col(c).ilike(like), F.lit(False))
        for c in arrays:
            test = test | F.coalesce(F.array_join(c, " & ").ilike(like), F.lit(False))
        out = out.where(test)
    return out


_ENTRY = r"(?s)@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\s*\}(?=\s*(?:@|%|$))"
_FIELD = r'(?s)(\w+)\s*=\s*(?:\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}|"([^"]*)"|(\d+))'


def parse_bibtex(df: DataFrame, content: str = "content") -> DataFrame:
    """(entry_type, cite_key, fields): the entries of each text; fields in lower case, their first values."""
    t = F.concat(F.regexp_replace(col(content), r"(?m)^\s*%.*$", ""), F.lit("\n"))
    get = lambda p, i, c: F.regexp_extract_all(c, F.lit(p), F.lit(i))
    entries = F.arrays_zip(get(_ENTRY, 1, t).alias("kind"), get(_ENTRY, 2, t).alias("key"), get(_ENTRY, 3, t).alias("body"))
    e = df.select(F.explode(entries).alias("e"))
    body = F.col("e.body")
    pairs = F.arrays_zip(get(_FIELD, 1, body).alias("k"), get(_FIELD, 2, body).alias("a"), get(_FIELD, 3, body).alias("b"), get(_FIELD, 4, body).alias("c"))
    pairs = F.transform(pairs, lambda p: F.struct(F.lower(p["k"]).alias("key"), F.trim(F.regexp_replace(F.concat(p["a"], p["b"], p["c"]), r"[{}]|\s+", " ")).alias("value")))
    once = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, p: F.when(F.map_contains_key(acc, p["key"]), acc).otherwise(F.map_concat(acc, F.map_from_entries(F.array(p)))))
    return e.select(F.lower("e.kind").alias("entry_type"), F.col("e.key").alias("cite_key"), once.alias("fields"))


def to_bibtex(items: DataFrame, key: str, entry_type: str, fields) -> DataFrame:
    """items with `bibtex`: an entry of the fields that aren't empty, special characters escaped."""

    def line(c):
        v = F.array_join(c, " and ") if dict(items.dtypes)[c].startswith("array") else F.col(c).cast("string")
        v = F.regexp_replace(v, r"([\\{}%&$#_])", r"\\$1")
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"  {c} = {{"), v, F.lit("}")))

    return items.withColumn("bibtex", F.concat(F.lit("@"), F.col(entry_type), F.lit("{"), F.col(key), F.lit(",\n"), F.concat_ws(",\n", *[line(c) for c in fields]), F.lit("\n}")))


def format_authors(names) -> str:
    """Authors "Last, First" joined for one cell."""
    return " & ".join(re.sub(r"\s+", " ", n).strip() for n in names if n and n.strip())
