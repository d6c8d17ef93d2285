"""The logical tables of the engine, from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import keywords_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str, keywords: bool = False) -> DataFrame:
    """documents as paragraphs: id, source (file id), lang, content and, if asked for, keywords."""
    d = table(spark, sf_dir, "documents")
    p = d.select(F.col("doc_id").alias("id"), F.concat_ws("/", F.lit("corpus"), "lang", "source").alias("source"), F.col("text").alias("content"), "lang", F.length("text").alias("n"))
    return p.withColumn("keywords", keywords_of("content")) if keywords else p


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file metadata: one file for each language and source, its path also its id."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit("corpus"), "lang", "source")
    return d.select(path.alias("path"), "lang", F.col("source").alias("name"), F.octet_length("text").cast("long").alias("b")).groupBy("path", "lang", "name").agg(F.sum("b").alias("size_bytes")).withColumn("id", F.col("path"))


def file_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge: a file belongs to the data set of its language and to the one below it, lang--name."""
    f = files(spark, sf_dir)
    return f.select(F.explode(F.array("lang", F.concat_ws("--", "lang", "name"))).alias("dataset"), F.col("id").alias("file_id"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_datasets(spark, sf_dir).select(F.col("dataset").alias("name")).distinct().withColumn("order_weight", F.lit(999))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as ordered paragraphs."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("source"), F.col("turn").alias("source_page"), F.col("role").alias("author"), F.col("text").alias("content"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
