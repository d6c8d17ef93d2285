"""Vector search and similarity over arrays of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, norm


def _query(vector):
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest_per_record(embeddings: DataFrame, vector) -> DataFrame:
    """(id, source where there is one, chunk_id, distance): each record's chunk that is nearest by cosine distance."""
    key = [c for c in ("id", "source") if c in embeddings.columns]
    d = embeddings.select(*key, "chunk_id", (1 - cosine(F.col("embedding").cast("array<double>"), _query(vector))).alias("distance"))
    d = d.where(F.col("distance").isNotNull())
    return d.groupBy(*key).agg(F.min(F.struct("distance", "chunk_id")).alias("best")).select(*key, "best.chunk_id", "best.distance")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, query_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, rank, id, cosine): the k nearest rows of `vectors` (id, v) for each query (query_id, v).

    Queries are broadcast while they are under query_bytes; more of them are
    taken in that many blocks by the hash of their ids.
    """
    stats = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-(stats[0] * 8 * (stats[1] or 0)) // query_bytes))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = _top(vectors, *_matrix(part.select(F.col("query_id").alias("id"), "v").where(F.col("v").isNotNull()).toArrow()), k)
        out = found if out is None else out.union(found)
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


def _top(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, rows: int = 2048, columns: int = 2048, pairs: int = 1 << 17) -> DataFrame:
    """Each partition's k best for each query (unit vectors q): matrix products of `rows` by `columns`.

    Products tell what can be among the best; their cosines are then summed one
    by one, so that equal vectors have equal cosines wherever they stand.
    """
    from ..ship import ship

    spark = vectors.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = held.value
        best = np.full((len(ids), k), -np.inf)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)

        def merge(j, s, own):
            """Candidates of queries j."""
            mine = np.unique(j)
            j = np.concatenate((j, np.repeat(mine, k)))
            s, own = np.concatenate((s, best[mine].ravel())), np.concatenate((own, best_id[mine].ravel()))
            order = np.lexsort((own, -s, j))
            j = j[order]
            place = np.arange(len(j)) - np.searchsorted(j, j)
            top = place < k
            best[j[top], place[top]] = s[order][top]
            best_id[j[top], place[top]] = own[order][top]

        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own, x = _matrix(pa.Table.from_batches([batch]))
            for low in range(0, len(own), rows):
                part, names = x[low : low + rows], own[low : low + rows]
                for first in range(0, len(ids), columns):
                    there = q[first : first + columns]
                    s = part @ there.T
                    least = best[first : first + columns, -1]
                    if len(part) > k and np.isinf(least).any():
                        least = np.maximum(least, np.partition(s, len(part) - k, axis=0)[len(part) - k])
                    i, j = np.nonzero(s >= least - 1e-9)
                    for at in range(0, len(i), pairs):
                        a, b = i[at : at + pairs], j[at : at + pairs]
                        merge(b + first, (part[a] * there[b]).sum(1), names[a])
        at, place = np.nonzero(best > -np.inf)
        for low in range(0, len(at), 1 << 20):
            a, p = at[low : low + (1 << 20)], place[low : low + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(best_id[a, p]), pa.array(best[a, p])], ["query_id", "id", "cosine"])

    return vectors.select("id", "v").where(F.col("v").isNotNull()).mapInArrow(run, "query_id long, id long, cosine double")


def pairwise_cosine(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """(a, b, cosine) with a < b and cosine >= threshold, exactly, as products of blocks.

    Rows are dealt to blocks by hash; each pair of blocks is one task's matrix
    product, so every row is sent once per block, not once per row.
    """

    def choose(s, a, b):
        i, j = np.nonzero(s >= threshold - 1e-12)
        return i, j

    return _products(vectors, choose, block)


def linked(vectors: DataFrame, threshold: float, block_bytes: int = 16 << 20) -> DataFrame:
    """(a, b): edges with the components of all pairs of cosine >= threshold, and no more than some for each row.

    Blocks of rows go to all tasks, which join what is linked and send a tree of
    it. Pairs inside the largest component found so far need no comparison: its
    rows go into no further block, and a task leaves out pairs that are joined in
    its own tree. Every other pair is compared.
    """
    from .graph import components, written

    v = vectors.select("id", "v").where(F.col("v").isNotNull())
    n, width = v.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * 8 * (width or 0) // block_bytes))
    of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    edges, largest, whole, at, rounds = None, None, 0, 0, 0
    while at < blocks:
        left, upto = v.where(of >= at), at + 1
        if largest is not None:
            left = left.join(largest, "id", "left_anti")
            # what is left of some blocks goes together
            sizes = dict(left.groupBy(of.alias("g")).count().collect())
            held = sizes.get(at, 0)
            while upto < blocks and (held + sizes.get(upto, 0)) * 8 * (width or 0) <= block_bytes:
                held += sizes.get(upto, 0)
                upto += 1
        else:
            held = 1
        if held:
            # rows of blocks that went whole have met every row
            new = written(_tree(v.where(of >= whole), left.where(of < upto), threshold).distinct())
            edges = new if edges is None else edges.union(new)
        if largest is None:
            whole = upto
        at, rounds = upto, rounds + 1
        if at < blocks and rounds & (rounds - 1) == 0 and held and not new.isEmpty():
            found = components(edges)
            edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
            top = found.groupBy("component").count().orderBy(F.col("count").desc(), "component").limit(1).select("component")
            largest = found.join(F.broadcast(top), "component").select(F.col("node").alias("id"))
    return edges if edges is not None else v.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)


def _tree(vectors: DataFrame, block: DataFrame, threshold: float, rows: int = 1024, columns: int = 4096) -> DataFrame:
    """(a, b): of each task, edges that join what rows of `vectors` and of the block are linked by."""
    from ..ship import ship

    spark = vectors.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(_matrix(block.select("id", "v").toArrow()))

    def run(batches):
        names, y = sent.value
        label = np.arange(len(names))  # of the block's rows: the first one of what they are joined with
        big = -1

        def join(a, b):
            """Labels a[i] and b[i] become one."""
            nonlocal label, big
            if not len(a):
                return
            while True:
                a, b = label[a], label[b]
                differ = a != b
                if not differ.any():
                    break
                a, b = a[differ], b[differ]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label != (jump := label[label])).any():
                    label = jump
            big = int(np.bincount(label).argmax())

        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            ids, x = _matrix(pa.Table.from_batches([batch]))
            mine = np.full(len(ids), -1)  # of the batch's rows: a row of the block that they are joined with
            for low in range(0, len(ids), rows):
                here = np.arange(low, min(low + rows, len(ids)))
                for first in range(0, len(names), columns):
                    there = np.arange(first, min(first + columns, len(names)))
                    out = (mine[here] < 0) | (label[mine[here]] != big)
                    for i, j in ((here[out], there), (here[~out], there[label[there] != big])):
                        if len(i) and len(j):
                            r, c = np.nonzero(x[i] @ y[j].T >= threshold - 1e-12)
                            r, c = i[r], j[c]
                            new = mine[r] < 0
                            mine[r[new][::-1]] = c[new][::-1]
                            join(mine[r], c)
            has = mine >= 0
            a, b = ids[has], names[label[mine[has]]]
            yield pa.record_batch([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])
        a, b = names, names[label]
        yield pa.record_batch([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return vectors.mapInArrow(run, "a long, b long")


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of a table (id, v); vectors without length stay."""
    ids = t.column("id").to_numpy().astype(np.int64)
    v = t.column("v").combine_chunks()
    v = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    length = np.sqrt((v**2).sum(1, keepdims=True))
    return ids, np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def heaviest_pairs(vectors: DataFrame, k: int, digits: int = 9, block: int = 2048) -> DataFrame:
    """(a, b, cosine): the k pairs of the greatest cosines, rounded to some digits, ties by a, then b.

    Each pair of blocks gives its own k best only.
    """

    def choose(s, a, b):
        ok = np.ones(s.shape, bool) if b is not a else np.triu(np.ones(s.shape, bool), 1)
        i, j = np.nonzero(ok)
        w = np.round(s[i, j], digits)
        low, high = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
        if len(w) > k:
            least = np.partition(w, len(w) - k)[len(w) - k]
            keep = np.flatnonzero(w >= least)
            i, j, w, low, high = i[keep], j[keep], w[keep], low[keep], high[keep]
        top = np.lexsort((high, low, -w))[:k]
        return i[top], j[top]

    found = _products(vectors, choose, block, upper=True).withColumn("cosine", F.round("cosine", digits))
    return found.orderBy(F.col("cosine").desc(), "a", "b").limit(k)


def _products(vectors: DataFrame, choose, block: int, upper: bool = False) -> DataFrame:
    """(a, b, cosine), a < b, of the places that choose(cosines, row ids, column ids) takes from each pair of blocks.

    A block with itself has each pair twice; with `upper` choose takes it once.
    """
    from ..ship import ship

    spark = vectors.sparkSession
    ship(spark)
    n = vectors.count()
    blocks = max(1, -(-n // block))
    mine = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("g"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = mine.select("id", "v", "g", each.alias("o")).select("id", "v", "g", F.least("g", "o").alias("x"), F.greatest("g", "o").alias("y"))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, g = t.column("id").to_numpy(), t.column("g").to_numpy()
        v = np.array(t.column("v").to_pylist(), float).reshape(len(ids), -1)
        length = np.sqrt((v**2).sum(1, keepdims=True))
        v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
        x, y = key[0].as_py(), key[1].as_py()
        left = np.flatnonzero(g == x)
        right = left if x == y else np.flatnonzero(g == y)
        s = v[left] @ v[right].T
        rows, columns = ids[left], ids[right]
        i, j = choose(s, rows, rows if x == y else columns)
        a, b, s = rows[i], columns[j], s[i, j]
        keep = a < b if x == y and not upper else np.ones(len(a), bool)
        a, b, s = a[keep], b[keep], s[keep]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": s})

    return dealt.groupBy("x", "y").applyInArrow(run, "a long, b long, cosine double")


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, v): the unit vector of the sum of each label's vectors."""
    parts = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    whole = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select("label", F.transform("p", lambda e: e["x"]).alias("s"))
    length = norm("s")
    return whole.select("label", F.transform("s", lambda x: F.try_divide(x, length)).alias("v"))


def classify(vectors: DataFrame, labelled: DataFrame) -> DataFrame:
    """(id, label, score): the label whose centroid has the greatest positive dot product, else none.

    The centroids, one for each label, go to every task; their number is checked.
    """
    c = centroids(labelled).withColumnRenamed("v", "c")
    if c.count() > 100_000:
        raise ValueError("too many labels for one broadcast")
    scored = vectors.select("id", "v").join(F.broadcast(c)).select("id", "label", dot("v", "c").alias("score"))
    best = scored.groupBy("id").agg(F.max(F.struct(F.col("score"), (-F.col("label")).alias("m"))).alias("x"))
    return best.select("id", F.when(F.col("x.score") > 0, -F.col("x.m")).alias("label"), F.col("x.score").alias("score"))
