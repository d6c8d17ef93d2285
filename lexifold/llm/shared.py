"""Lineage cuts in the shared folder, and connected components."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (as in tests) one below the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    del df
    # Spark deletes the shuffle files of plans that nothing refers to any more, once the JVM has seen that.
    gc.collect()
    context._jvm.System.gc()
    return out


EDGES_A_TASK = 100_000


def _few(df: DataFrame, n: int) -> DataFrame:
    """df in as many partitions as n rows need: small tables then take no shuffle, and leave no small files."""
    return df.coalesce(max(1, -(-n // EDGES_A_TASK)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by edges, for every node of an edge.

    Alternating large-star and small-star steps: each round a node's neighbours
    are linked to the smallest of them, so hubs lose all but one edge and the
    number of edges never grows; a logarithmic number of rounds in practice.
    """
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    n = now.count()
    while True:
        now = _few(now, n)
        both = _few(now.union(now.select("v", "u")), 2 * n)
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(small, "u")
        linked = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = cut(linked.select("e.u", "e.v").where("u <> v").distinct())
        n = new.count()
        old, new = now, _few(new, n)
        same = old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()
        now = new
        if same:
            break
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node")).distinct().join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.union(roots)
