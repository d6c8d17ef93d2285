"""Exact top-k search by integer inner product with M-trees.

Vectors are turned to integers floor(scale * x). With m the largest squared
norm, each vector gets one more coordinate, sqrt(m - its squared norm), and a
query the coordinate 0: then the squared distance is |q|^2 + m - 2 (q . v), so
nearest by distance is greatest by inner product, and the metric bounds hold.

Rows are numbered, and all but the query's own are candidates, whatever their ids.
They are dealt by number into shards of about `shard_rows` rows, so no vector
however common is special. A sample of all rows gives each query a score that its
results reach at least, which every shard's search starts with. A shard is one M-tree: pages of up to `page` entries,
routing entries with covering radii, and for every entry its distance to the
parent's routing object. A best-first search keeps pages by their least possible
distance; the stored parent distances rule entries out before any distance is
computed. Queries stream through each shard; scores are exact integers and ties
go to the smaller id.

Integers of components are held within +-2**60. Where products might leave 64
bits they are taken in Python's integers, ranks follow up to 38 digits, and a
score that does not fit a long is the nearest long.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import cut

SAMPLE = 2048
EDGE = 1 << 60  # of a component's integer
LONG = (1 << 63) - 1
DIGITS = 10**38 - 1
SLACK = 1e-6  # relative; far above the rounding of float64 sums of some hundred squares


class MTree:
    """Bulk-loaded over the rows of `points`; distances are Euclidean."""

    def __init__(self, points: np.ndarray, page: int = 64):
        self.points, self.page = points, page
        rows = np.arange(len(points))
        level = []  # (members, centre row, radius, distances to the centre)
        stack = [rows] if len(rows) else []
        while stack:  # halve by the nearer of two far-apart pivots until a page holds the rest
            part = stack.pop()
            if len(part) <= page:
                level.append(self._node(part))
                continue
            a = part[np.argmax(self._distance(part, part[0]))]
            da = self._distance(part, a)
            b = part[np.argmax(da)]
            order = np.argsort(da - self._distance(part, b), kind="stable")  # halves of equal size, ties included
            half = len(part) // 2
            stack += [part[order[:half]], part[order[half:]]]
        self.nodes = list(level)  # leaves: entries are rows
        self.leaves = len(level)
        ids = list(range(len(level)))
        while len(ids) > 1:  # inner pages: entries are nodes, neighbours of the halving order together
            up = []
            for at in range(0, len(ids), page):
                children = np.array(ids[at : at + page])
                centres = np.array([self.nodes[c][1] for c in children])
                centre = centres[np.argmin(self.points[centres] @ -self.points[centres].mean(0) * 2 + (self.points[centres] ** 2).sum(1))]
                d = self._distance(centres, centre)
                radius = float((d + np.array([self.nodes[c][2] for c in children])).max())
                self.nodes.append((children, centre, radius, d))
                up.append(len(self.nodes) - 1)
            ids = up
        self.root = ids[0] if ids else None
        self.radii = np.array([n[2] for n in self.nodes])
        self.centres = np.array([n[1] for n in self.nodes], np.int64)

    def _distance(self, rows, to):
        x = self.points[rows] - self.points[to]
        return np.sqrt(np.einsum("ij,ij->i", x, x))

    def _node(self, part):
        mean = self.points[part].mean(0)
        centre = part[np.argmin(((self.points[part] - mean) ** 2).sum(1))]
        d = self._distance(part, centre)
        return part, int(centre), float(d.max()), d

    def search(self, q: np.ndarray, offer, limit):
        """Calls offer(rows) with pages' candidate rows; limit() is the greatest distance still wanted."""
        if self.root is None:
            return
        d = float(np.sqrt(((self.points[self.centres[self.root]] - q) ** 2).sum()))
        queue = [(max(0.0, d - self.radii[self.root]), self.root, d)]
        while queue:
            low, node, d = heapq.heappop(queue)
            reach = limit()
            if low > reach:
                break
            entries, _, _, to_parent = self.nodes[node]
            if node < self.leaves:
                keep = np.abs(d - to_parent) <= reach
                if keep.any():
                    offer(entries[keep])
                continue
            keep = np.abs(d - to_parent) - self.radii[entries] <= reach
            entries = entries[keep]
            x = self.points[self.centres[entries]] - q
            dist = np.sqrt(np.einsum("ij,ij->i", x, x))
            low = np.maximum(0.0, dist - self.radii[entries])
            for l, e, x in zip(low.tolist(), entries.tolist(), dist.tolist()):
                if l <= reach:
                    heapq.heappush(queue, (l, e, x))


def integers(table: DataFrame, scale: int = 1024, *more: str) -> DataFrame:
    """(vec_id, v, more columns): the rows without null or non-finite components, components as integers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-float(EDGE)), F.least(F.lit(float(EDGE)), c * F.lit(float(scale))))).cast("long"))
    return table.select("vec_id", "embedding", x.alias("x"), *more).where(good).select("vec_id", whole.alias("v"), *more)


def top_k(table: DataFrame, k: int = 10, every: int = 100, shard_rows: int = 16384, page: int = 64, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by `every`.

    Rows that share an id are rows, and queries, of their own; rows without an id
    take no part; other columns of the table are not looked at. Vectors of another length than a query have no score with it: the result
    is over vectors of equal length.
    """
    spark = table.sparkSession
    tb.ship(spark)
    rows = cut(integers(table, scale).withColumn("row", F.monotonically_increasing_id()))
    size = F.size("v")
    norm = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    stats = rows.select(size.alias("dim"), norm.alias("norm")).agg(F.count("*"), F.max("norm")).first()
    shards = max(1, -(-(stats[0] or 0) // shard_rows))
    largest = float(stats[1] or 0) * (1 + 1e-9)
    number = np.dtype(object if largest >= 2.0**62 else np.int64)  # no product is greater than the largest norm
    data = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "vec_id", "row", "v", F.lit(None).cast("decimal(38,0)").alias("least"))
    sample: dict = {}  # by length of vectors
    for v in rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow().column("v").to_pylist():
        sample.setdefault(len(v), []).append(v)
    sample = {dim: np.array(v, number) for dim, v in sample.items()}

    def bounds(batches):
        """With the least score that each query's results have, as far as the sample tells; the query may be in it."""
        for batch in batches:
            found = []
            for v in batch.column("v").to_pylist():
                s = sample[len(v)] @ np.array(v, number) if len(v) in sample else ()
                found.append(Decimal(max(-DIGITS, min(DIGITS, sorted(s.tolist())[-k - 1]))) if len(s) > k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.decimal128(38))], [*batch.schema.names, "least"])

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "row", "v").mapInArrow(bounds, "vec_id long, row long, v array<long>, least decimal(38,0)")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    queries = queries.select(each.alias("shard"), F.lit(1).alias("kind"), "vec_id", "row", "v", "least")

    def run(batches):
        trees: dict = {}  # by length of vectors
        held: list = []
        shard = None

        def build():
            trees.clear()
            by_dim: dict = {}
            for ids, numbers, values in held:
                for i, n, v in zip(ids, numbers, values):
                    by_dim.setdefault(len(v), []).append((i, n, v))
            for dim, found in by_dim.items():
                ids, numbers = (np.array([x[c] for x in found]) for c in (0, 1))
                v = np.array([x[2] for x in found], number)
                extra = np.sqrt(np.maximum(0, largest - (v.astype(float) ** 2).sum(1)))
                trees[dim] = ids, numbers, v, MTree(np.concatenate((v.astype(float), extra[:, None]), 1), page)
            held.clear()

        for batch in batches:
            s, kind, ids, numbers = (batch.column(c).to_numpy() for c in ("shard", "kind", "vec_id", "row"))
            values, least = batch.column("v").to_pylist(), batch.column("least").to_pylist()
            out: list = []
            at = 0
            while at < len(s):
                to = at + int(np.argmax(np.append((s[at:] != s[at]) | (kind[at:] != kind[at]), True)))
                if s[at] != shard:
                    trees.clear()
                    held.clear()
                    shard = s[at]
                if kind[at] == 0:
                    held.append((ids[at:to].tolist(), numbers[at:to].tolist(), values[at:to]))
                else:
                    if held:
                        build()
                    for i in range(at, to):
                        if len(values[i]) in trees:
                            found = _best(trees[len(values[i])], int(numbers[i]), np.array(values[i], number), k, largest, least[i])
                            out += [(int(numbers[i]), int(ids[i]), *x) for x in found]
                at = to
            cols = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["query", "query_id", "vec_id", "row", "score"])

    dealt = data.union(queries).repartition("shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(run, "query long, query_id long, vec_id long, row long, score decimal(38,0)")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row"))
    fits = F.greatest(F.lit(-LONG - 1), F.least(F.lit(LONG), F.col("score"))).cast("long")
    return found.select("query_id", rank.alias("rank"), "vec_id", fits.alias("score")).where(F.col("rank") <= k)


def _best(tree, query, q, k, largest, least):
    """(id, row, score) of the k best rows but the query's own; none scores below `least`, if given."""
    ids, numbers, v, m = tree
    point = np.append(q.astype(float), 0.0)
    base = float((q.astype(float) ** 2).sum()) + largest
    best: list = []  # (score, -id, -row), the worst first
    least = None if least is None else int(least)

    def offer(rows):
        scores = v[rows] @ q
        worst = wanted()
        if worst is not None:
            keep = scores >= worst
            rows, scores = rows[keep], scores[keep]
        for s, i, n in zip(scores.tolist(), ids[rows].tolist(), numbers[rows].tolist()):
            if n != query:
                if len(best) < k:
                    heapq.heappush(best, (s, -i, -n))
                elif (s, -i, -n) > best[0]:
                    heapq.heapreplace(best, (s, -i, -n))

    def wanted():
        """The least score that still counts."""
        if len(best) < k:
            return least
        return best[0][0] if least is None else max(least, best[0][0])

    def limit():
        worst = wanted()
        if worst is None:
            return float("inf")
        return np.sqrt(max(0.0, base - 2 * float(worst))) * (1 + SLACK) + SLACK * np.sqrt(base) + SLACK

    m.search(point, offer, limit)
    return [(-i, -n, max(-DIGITS, min(DIGITS, s))) for s, i, n in best]


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, e.r, e.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.r <> q.r AND len(e.v) = len(q.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
