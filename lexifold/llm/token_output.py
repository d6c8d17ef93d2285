"""Token-ID output: documents in ascending doc_id order as Re-Pair-compressed shards.

The files are Parquet with one row per shard (`part`, `shard`, `doc_ids`, `blob`;
the blob as in repair.py), so any file system that Spark reaches takes them. A
shard ends at `shard_ids` ids or after a longer document. Reading decodes each
document from its own symbols alone. Null texts are empty documents; rows without a doc_id come first, equal doc_ids in the order of their
texts.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .repair import Shard, pack
from .tokens import WordEncoder, default_path, read_tokenizer


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2, shard_ids: int = 2 << 20) -> None:
    """Encodes docs (doc_id, text) and writes the shards to path. end: an id of the tokenizer, or one beyond."""
    spark = docs.sparkSession
    tb.ship(spark)
    vocabulary = read_tokenizer(tokenizer or default_path())
    base = max(WordEncoder.shared(vocabulary).size_of_vocabulary(), end + 1)
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = WordEncoder.shared(held.value)
        part, shard = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list = []
        names: list = []
        total = 0

        def flush():
            nonlocal shard, total
            size = np.concatenate(sizes)
            blob = pack(np.concatenate(ids), size, base)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([total], pa.int64()), pa.array([sum(names, [])], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                ["part", "shard", "n_tokens", "doc_ids", "blob"],
            )
            shard, total = shard + 1, 0
            for x in (ids, sizes, names):
                x.clear()
            return batch

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for block in tb.blocks(batch.column("text")):
                got, size = encoder.encode(block)
                with_end = np.empty(len(got) + len(size), np.int32)
                ends = np.cumsum(size + 1) - 1
                body = np.ones(len(with_end), bool)
                body[ends] = False
                with_end[body] = got
                with_end[ends] = end
                ids.append(with_end)
                sizes.append(size + 1)
                names.append(doc_ids[block.rows.start : block.rows.start + len(block)])
                total += len(with_end)
                if total >= shard_ids:
                    yield flush()
        if total:
            yield flush()

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, "part int, shard int, n_tokens long, doc_ids array<long>, blob binary").write.parquet(path)


def read(spark, path: str, end: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards in path."""
    tb.ship(spark)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column("blob")[row].as_py(), end)
                n = len(shard.sizes)
                crc, found = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for i in range(n):
                    ids = shard.document(i)
                    crc[i], found[i] = zlib.crc32(ids.tobytes()), len(ids)
                starts = np.cumsum(found) - found
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[row].as_py()] * n, pa.int32()) for c in ("part", "shard")]
                    + [batch.column("doc_ids")[row].values, pa.array(starts), pa.array(found), pa.array(crc)],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(path)
    rows = files.select("part", "shard", "doc_ids", "blob").mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # Where each part begins, then each shard of it: one row a part in the first window, one part's shards in the second.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("all")).withColumn("part_start", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    inner = files.select("part", "shard", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")).alias("upto"), "n_tokens")
    starts = inner.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("upto") - F.col("n_tokens")).alias("shard_start"))
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def scratch(spark, name: str) -> str:
    """A new folder in the shared one that the cluster names."""
    from .shared import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards to the shared folder and reads them back."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
