"""Queue-like refresh jobs as micro-batches. All are idempotent by key, so a batch may run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import chunks
from ..operators.external import embed


def chunk_rows(paragraphs: DataFrame, length: int = 200, overlap: int = 50) -> DataFrame:
    """(id, source, chunk_id, chunk)."""
    c = paragraphs.select("id", "source", F.explode(chunks("content", length, overlap)).alias("c"))
    return c.select("id", "source", "c.chunk_id", "c.chunk")


def refresh_embeddings(paragraphs: DataFrame, path: str, encode, length: int = 200, overlap: int = 50, least: int = 10, checkpoint: str | None = None, every: str | None = None):
    """Starts the refresh: each micro-batch of new paragraphs is encoded and appended to path, those already there left out."""
    spark = paragraphs.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        new = df.where(F.char_length("content") > least).dropDuplicates(["id", "source"])
        if _exists(spark, path):
            new = new.join(spark.read.parquet(path).select("id", "source").distinct(), ["id", "source"], "left_anti")
        embed(chunk_rows(new, length, overlap), encode).drop("chunk").write.mode("append").parquet(path)

    w = paragraphs.writeStream.foreachBatch(batch)
    w = w.option("checkpointLocation", checkpoint) if checkpoint else w
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str = "path", order: str = "at") -> DataFrame:
    """snapshot after changes (key, kind = upsert or delete, order, fields): the last change of a key counts."""
    from ..operators.snapshots import latest_by

    last = latest_by(changes, key, order)
    kept = snapshot.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("kind = 'upsert'").select(*snapshot.columns))


def watch_files(changes: DataFrame, path: str, key: str = "path", order: str = "at", checkpoint: str | None = None):
    """Keeps numbered snapshots path/v=N by micro-batches of changes; a batch writes its own number, so it may run again."""
    spark = changes.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        columns = [c for c in df.columns if c not in ("kind", order)]
        before = spark.read.parquet(f"{path}/v={number - 1}") if number and _exists(spark, f"{path}/v={number - 1}") else df.select(*columns).limit(0)
        apply_changes(before, df, key, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    w = changes.writeStream.foreachBatch(batch).trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, event_type, n, total) by day windows; an extension. ts is cast, as watermarks need a time zone."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")
