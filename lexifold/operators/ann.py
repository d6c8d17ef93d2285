"""A stored index for nearest neighbours by cosine: inverted lists with quantised residuals.

Fitting: centroids of directions, and codebooks for the residuals of each part of
the vector, by k-means over a bounded sample. Building: every row goes to the
list of its nearest centroid, with a code of one byte for each part, and is
written to a table partitioned by list. Searching: a query reads only the lists
of its nearest centroids (the scan prunes the others' partitions), ranks rows by
its distances to the codewords, and takes exact cosines of the best ranked.
Long lists are long files, which the scan splits over tasks; no row is shuffled.
`exact` asks every list that could hold one of the k nearest by its angular radius.

Rows without an id, without a vector, with null or non-finite components or
without length are not in the index; ids may repeat. All vectors must have one length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..folders import scratch
from ..ship import ship

SAMPLE = 16384  # rows the index is fitted on
ROUNDS = 10


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x**2).sum(-1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def k_means(x: np.ndarray, k: int, directions: bool = False) -> np.ndarray:
    """k centres (fewer if there are fewer rows); starts from rows spread over the input, so the same rows give the same centres."""
    k = min(k, len(x))
    if not k:
        return x[:0]
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest_centre(x, centre)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
        if directions:
            centre = unit(centre)
    return centre


def nearest_centre(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(1)[None, :] - 2 * x @ centre.T, 1) if len(centre) else np.zeros(len(x), int)


@dataclass
class Model:
    """lists: unit centroids. books[p]: the codewords of part p, of the components cuts[p] to cuts[p + 1]."""

    lists: np.ndarray
    books: list
    cuts: list

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int, words: int = 256) -> "Model":
        x = unit(x)
        centre = k_means(x, lists, directions=True)
        rest = x - centre[nearest_centre(x, centre)] if len(x) else x
        cuts = np.linspace(0, x.shape[1], min(parts, max(1, x.shape[1])) + 1).astype(int).tolist()
        return cls(centre, [k_means(rest[:, a:b], words) for a, b in zip(cuts, cuts[1:])], cuts)

    def encode(self, x: np.ndarray):
        """(list of each row, codes, cosine with the list's centroid) of unit vectors."""
        own = nearest_centre(x, self.lists)
        rest = x - self.lists[own]
        codes = np.stack([nearest_centre(rest[:, a:b], w) for w, a, b in zip(self.books, self.cuts, self.cuts[1:])], 1).astype(np.uint8)
        return own, codes, (x * self.lists[own]).sum(1)

    def estimate(self, q: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """q's products with the vectors that the codes of a list stand for."""
        out = np.full(len(codes), float(q @ self.lists[number]))
        for p, (words, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            out += (words @ q[a:b])[codes[:, p]]
        return out


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v) of rows that can have a cosine."""
    v = F.col("v").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("id", v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


class Index:
    """An index stored below a path: rows/list=N, lists (list, n, least cosine with the centroid) and the model."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        ship(spark)
        m = spark.read.parquet(f"{path}/model").first()
        lists = np.array(m["lists"], float)
        books, at = [], 0
        flat = np.array(m["books"], float)
        for n, a, b in zip(m["words"], m["cuts"], m["cuts"][1:]):
            books.append(flat[at : at + n * (b - a)].reshape(n, b - a))
            at += n * (b - a)
        self.model = Model(lists.reshape(-1, max(1, m["cuts"][-1])), books, m["cuts"])
        found = spark.read.parquet(f"{path}/lists").collect()
        self.radius = {r["list"]: math.acos(max(-1.0, min(1.0, r["least"]))) for r in found}

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, parts: int = 16) -> "Index":
        """Builds the index of (id, v); lists: by default the square root of the number of rows, at most a quarter of the sample."""
        spark = vectors.sparkSession
        ship(spark)
        rows = usable(vectors)
        n = rows.count()
        lists = lists or max(1, min(SAMPLE // 4, round(math.sqrt(n))))
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        model = Model.fit(_matrix(drawn.column("v").combine_chunks()), lists, parts)
        spark.createDataFrame(
            [(model.lists.ravel().tolist(), np.concatenate([b.ravel() for b in model.books]).tolist(), [len(b) for b in model.books], model.cuts)],
            "lists array<double>, books array<double>, words array<int>, cuts array<int>",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

        def code(batches):
            for batch in batches:
                own, codes, cosine = model.encode(unit(_matrix(batch.column("v"))))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), packed, pa.array(cosine), pa.array(own, pa.int32())], ["id", "v", "code", "cosine", "list"])

        coded = rows.mapInArrow(code, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, code binary, cosine double, list int")
        # rebalancing cuts lists that are long and joins those that are short
        coded.hint("rebalance", "list").select("id", F.col("v").cast("array<float>").alias("v"), "code", "cosine", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
        written = spark.read.schema("cosine double, list int").parquet(f"{path}/rows") if n else coded.limit(0)
        counts = written.groupBy("list").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        return cls(spark, path)

    def rows(self, lists) -> DataFrame:
        """The rows of some lists; the scan reads only their partitions."""
        kind = self.spark.read.parquet(f"{self.path}/rows").schema["id"].dataType.simpleString()
        return self.spark.read.schema(f"id {kind}, v array<float>, code binary, list int").parquet(f"{self.path}/rows").where(F.col("list").isin(*lists))

    def near_lists(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(q @ self.model.lists.T), 1, kind="stable")[:, :probes]

    def search(self, queries: DataFrame, k: int, probes: int = 8, ranked: int = 0) -> DataFrame:
        """(query_id, rank, id, cosine): of (query_id, v) the k nearest rows in the `probes` nearest lists, as codes tell.

        Of what a task reads the `ranked` rows (default 4 k) of the greatest
        estimates get exact cosines. Queries go in blocks of bounded size.
        """
        return self._ranked(self._ask(queries, lambda q, _: self.near_lists(q, probes).tolist(), k, ranked or 4 * k), k)

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """As search, but certainly the k nearest of all rows.

        The nearest list gives each query a cosine to beat; then all lists whose
        cone of rows reaches into the query's cone of that angle are read.
        """
        first = self._ranked(self._ask(queries, lambda q, _: self.near_lists(q, 1).tolist(), k, 0), k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("bound"))
        bounded = queries.join(first, "query_id", "left").select("query_id", "v", "bound")
        number = np.array(sorted(self.radius), int)
        radius = np.array([self.radius[i] for i in number.tolist()])

        def reachable(q, bounds):
            angle = np.arccos(np.clip(q @ self.model.lists[number].T, -1, 1)) - radius[None, :] - 1e-6
            most = np.cos(np.maximum(angle, 0))
            return [number[row >= (-2 if b is None else b)].tolist() for row, b in zip(most, bounds)]

        return self._ranked(self._ask(bounded, reachable, k, 0), k)

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")

    def _ask(self, queries: DataFrame, choose, k: int, ranked: int, block_bytes: int = 32 << 20) -> DataFrame:
        """(query_id, id, cosine) of the lists that choose(unit queries, bounds) names for each query; ranked = 0: without codes."""
        wanted = usable(queries.select(F.col("query_id").alias("id"), "v"))
        if "bound" in queries.columns:
            wanted = wanted.join(queries.select(F.col("query_id").alias("id"), "bound").distinct(), "id")
        width = self.model.cuts[-1]
        n = wanted.count()
        blocks = max(1, -(-n * width * 8 // block_bytes))
        out = None
        for b in range(blocks):
            part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
            found = self._block(part.toArrow(), wanted.schema["id"].dataType.simpleString(), choose, k, ranked)
            out = found if out is None else out.unionAll(found)
        return out

    def _block(self, table: pa.Table, kind: str, choose, k: int, ranked: int) -> DataFrame:
        table = table.combine_chunks()
        ids = table.column("id").to_pylist()
        q = unit(_matrix(table.column("v").combine_chunks())) if ids else np.zeros((0, self.model.cuts[-1]))
        bounds = table.column("bound").to_pylist() if "bound" in table.column_names else [None] * len(ids)
        asked: dict[int, list[int]] = {}
        for i, lists in enumerate(choose(q, bounds) if ids and len(self.model.lists) else []):
            for number in lists:
                if number in self.radius:
                    asked.setdefault(number, []).append(i)
        # what goes to every task: the block's queries, the model, and who asks which list
        held = self.spark.sparkContext.broadcast((q, {number: np.array(who) for number, who in asked.items()}, self.model))
        rows = self.rows(sorted(asked) or [-1])

        def run(batches):
            q, asked, model = held.value
            best: dict[int, list] = {}  # by query: (estimates or cosines, row ids, vectors)

            def keep(i, values, ids, v, most):
                s, r, w = best.get(i, (values[:0], ids[:0], v[:0]))
                s, r, w = np.concatenate((s, values)), np.concatenate((r, ids)), np.concatenate((w, v))
                if len(s) > most:
                    top = np.lexsort((r, -s))[:most] if ranked == 0 else np.argpartition(-s, most - 1)[:most]
                    s, r, w = s[top], r[top], w[top]
                best[i] = s, r, w

            for batch in batches:
                numbers = batch.column("list").to_numpy()
                row_ids = np.array(batch.column("id").to_pylist())
                v = _matrix(batch.column("v"))
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(v), -1)
                for number in np.unique(numbers).tolist():
                    at = np.flatnonzero(numbers == number)
                    x = unit(v[at]) if not ranked else None
                    for i in asked[number].tolist():
                        values = x @ q[i] if not ranked else model.estimate(q[i], number, codes[at])
                        most = ranked or k
                        top = np.argpartition(-values, most - 1)[:most] if ranked and len(values) > most else np.arange(len(values))
                        keep(i, values[top], row_ids[at[top]], v[at[top]], most)
            place, row, cosine = [], [], []
            for i, (s, r, w) in best.items():
                place += [i] * len(s)
                row += r.tolist()
                cosine += (unit(w) @ q[i]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(row), pa.array(cosine, pa.float64())], ["place", "id", "cosine"]) if place else pa.RecordBatch.from_pylist([], pa.schema([("place", pa.int32()), ("id", pa.int64() if id_kind in ("bigint", "int") else pa.string()), ("cosine", pa.float64())]))

        id_kind = rows.schema["id"].dataType.simpleString()
        found = rows.mapInArrow(run, f"place int, id {id_kind}, cosine double")
        names = self.spark.createDataFrame(pa.table({"place": pa.array(range(len(ids)), pa.int32()), "query_id": pa.array(ids)})) if ids else self.spark.createDataFrame([], f"place int, query_id {kind}")
        return found.join(F.broadcast(names), "place").select("query_id", "id", "cosine")


def recall(found: DataFrame, right: DataFrame) -> float:
    """The share of right's (query_id, id) that are in found."""
    hit = right.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return hit / max(1, right.count())


def temporary(vectors: DataFrame, name: str = "ann", **options) -> Index:
    """An index at a new path below the shared folder."""
    return Index.build(vectors, scratch(vectors.sparkSession, name), **options)
