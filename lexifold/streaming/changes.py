"""A table kept by a stream of changes: state a key, writes in proportion to what changed.

Changes are rows (key, order, kind = upsert or delete, fields). The last change of
a key, by its order, counts; of changes with equal order a deletion, then the
greatest fields. Keyed state holds it, so that late and repeated changes are told
from news and only news goes on; where the query runs on, a timer forgets a
deletion after a while (with timers Spark never takes a stream to be at its end,
so a query that ends with what is there keeps deletions in mind). The sink holds the table in buckets by key and
rewrites those in which something changed, then names the new state in one small
file: a batch that runs again rewrites the same, a reader never sees half of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..ship import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Latest(StatefulProcessor):
    """Emits a key's change if it is later than all before it and changes something."""

    def __init__(self, key: str, order: str, fields: list[str], kinds: dict, forget_ms: int | None):
        self.key, self.order, self.fields, self.kinds, self.forget_ms = key, order, fields, kinds, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField(c, self.kinds[c]) for c in (self.order, "kind", *self.fields)]))

    def handleInputRows(self, key, rows, timerValues):
        rank = lambda r: (r[0], r[1] == "delete", tuple((x is not None, str(x)) for x in r[2:]))
        before = tuple(self.last.get()) if self.last.exists() else None
        best = before
        for row in rows:
            new = tuple(row[c] for c in (self.order, "kind", *self.fields))
            if new[0] is not None and (best is None or rank(new) > rank(best)):
                best = new
        if best is None or best == before:
            return
        self.last.update(best)
        gone = best[1] == "delete"
        if gone and self.forget_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        same = before is not None and before[1] == best[1] and (gone or before[2:] == best[2:])
        if not same and not (before is None and gone):
            yield Row(**{self.key: key[0], self.order: best[0], "kind": best[1], **dict(zip(self.fields, best[2:]))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.last.get() if self.last.exists() else None
        if last is not None and last["kind"] == "delete":
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def news(changes: DataFrame, key: str = "path", order: str = "at", forget_ms: int | None = None) -> DataFrame:
    """The changes that change something, of a stream of changes; at most one of a key in a batch. Null keys are left out.

    forget_ms: after that long a deleted key is as one that never was (default: never).
    """
    spark = changes.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType for f in changes.schema}
    fields = [c for c in changes.columns if c not in (key, order, "kind")]
    out = T.StructType([T.StructField(c, kinds[c]) for c in (key, order, "kind", *fields)])
    processor = Latest(key, order, fields, kinds, forget_ms)
    rows = changes.where(F.col(key).isNotNull() & F.col("kind").isin("upsert", "delete"))
    return rows.groupBy(key).transformWithState(processor, out, "Update", "None" if forget_ms is None else "ProcessingTime")


class Table:
    """Rows in buckets below a path; versions/N names for each bucket the batch that wrote it last."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "path", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, before: int | None = None) -> dict[int, int]:
        """bucket -> the batch whose files hold it, in the last state, or the last before a batch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = self._fs()
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in numbers if (before is None or n < before) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{n}/_SUCCESS"))]
        return {r["bucket"]: r["batch"] for r in self.spark.read.parquet(f"{self.path}/versions/{max(done)}").collect()} if done else {}

    def _rows(self, versions: dict[int, int], only=None) -> DataFrame:
        paths = [f"{self.path}/rows/batch={n}/bucket={b}" for b, n in versions.items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.versions())

    def apply(self, batch: DataFrame, number: int) -> set[int]:
        """Writes the buckets that the news of a batch touch; gives their numbers."""
        new = batch.select(*self.schema.names, "kind").withColumn("bucket", self.bucket()).persist()
        try:
            touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
            if not touched:
                return touched
            versions = self.versions(number)
            kept = self._rows(versions, touched).join(new.select(self.key), self.key, "left_anti").withColumn("bucket", self.bucket())
            rows = kept.select(*self.schema.names, "bucket").unionByName(new.where("kind = 'upsert'").drop("kind"))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
            fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
            for b in touched:
                if fs.exists(path(f"{self.path}/rows/batch={number}/bucket={b}")):
                    versions[b] = number
                else:
                    versions.pop(b, None)  # nothing is left in it
            named = self.spark.createDataFrame(sorted(versions.items()), "bucket int, batch int").coalesce(1)
            named.write.mode("overwrite").parquet(f"{self.path}/versions/{number}")
            return touched
        finally:
            new.unpersist()

    def keep(self, changes: DataFrame, checkpoint: str, order: str = "at", every: str | None = None, forget_ms: int = 86_400_000):
        """Starts the query that keeps the table by a stream of changes: to the end of what is there, or for good, a batch `every` so often."""
        w = news(changes, self.key, order, forget_ms if every else None).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        w = w.foreachBatch(lambda df, number: self.apply(df, number) and None)
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def follow(spark: SparkSession, path: str, schema, files_a_batch: int = 100, kind: str = "parquet") -> DataFrame:
    """A stream of the files below a path, a bounded number of them in a batch: the backpressure of every job here."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(kind).load(path)
