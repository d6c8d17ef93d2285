"""The star join over a library: books with authors, tags and formats, and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete(facts: DataFrame, key: str, links: dict) -> DataFrame:
    """facts with one sorted, distinct array for each link.

    links: column -> (table, its column of the key, value expression). Each link
    is aggregated before it is joined, so authors and tags never multiply.
    """
    for name, (table, on, value) in links.items():
        agg = table.groupBy(F.col(on).alias(key)).agg(F.array_sort(F.collect_set(value)).alias(name))
        facts = facts.join(agg, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return facts


def book_records(tables: dict, formats=("epub", "pdf"), root: str = "") -> DataFrame:
    """One record for each file of a book in one of the formats, from the library's own tables.

    tables: books (id, title, path, pubdate), data (book, format, name) and, where
    there are any, authors, publishers, series and tags (id, name), each with its
    books_<name>_link (book, and author, publisher, series or tag). A book without
    such links has empty arrays and null texts; one without a file has no record.
    """
    books = tables["books"].select(F.col("id").alias("book_id"), F.col("title").alias("outline"), F.col("path").alias("__folder"), F.make_date(F.year("pubdate"), F.lit(1), F.lit(1)).alias("pdate"))
    links = {}
    for name, key in (("authors", "author"), ("publishers", "publisher"), ("series", "series"), ("tags", "tag")):
        if name in tables:
            named = tables[name].select(F.col("id").alias(key), F.trim("name").alias("__name"))
            links[name] = (tables[f"books_{name}_link"].join(named, key), "book", F.col("__name"))
    books = complete(books, "book_id", links)
    kind = F.lower("format")
    path = F.concat_ws("/", *([F.lit(root)] if root else []), "__folder", F.concat("__file", F.lit("."), "format"))
    of = tables["data"].where(kind.isin(*formats)).select(F.col("book").alias("book_id"), F.col("name").alias("__file"), kind.alias("format"))
    joined = lambda c, by: F.nullif(F.array_join(c, by), F.lit("")) if c in links else F.lit(None).cast("string")
    return books.join(of, "book_id").select(
        "book_id", "outline", joined("authors", " & ").alias("author"), "pdate", path.alias("content"), path.alias("source"), "format",
        joined("publishers", " & ").alias("publisher"), joined("series", " & ").alias("series"), (F.col("tags") if "tags" in links else F.array().cast("array<string>")).alias("tags"),
    )


def having(facts: DataFrame, key: str, links) -> DataFrame:
    """facts whose key every one of the (table, column, condition) filters knows: one semi-join each, no duplicates to remove."""
    for table, on, cond in links:
        facts = facts.join(table.where(cond).select(F.col(on).alias(key)), key, "left_semi")
    return facts


def statistics(books: DataFrame, cover: str, kind: str, rating: str):
    """(totals, by kind, by rating): counts; ratings that are null or zero are left out."""
    totals = books.agg(F.count("*").alias("total"), F.count_if(F.col(cover)).alias("with_cover"), F.count_if(~F.col(cover)).alias("without_cover"))
    kinds = books.groupBy(kind).agg(F.count("*").alias("n"))
    ratings = books.where(F.coalesce(F.col(rating), F.lit(0)) != 0).groupBy(rating).agg(F.count("*").alias("n"))
    return totals, kinds, ratings


def moved(files: DataFrame, books: DataFrame) -> DataFrame:
    """files with the new path of a book that is known by catalogue and call number under another one."""
    now = books.select("library_catalog", "call_number", F.col("path").alias("__new"))
    return files.join(now, ["library_catalog", "call_number"], "left").withColumn("moved", F.coalesce(F.col("__new") != F.col("path"), F.lit(False))).withColumn("path", F.coalesce("__new", "path")).drop("__new")
