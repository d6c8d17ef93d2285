"""Hard negatives: for each anchor and each of its best positives, the best rows of other labels in a score window.

Vectors are turned to integers floor(scale * x); scores are integer inner
products. With m the largest squared norm each vector gets one more coordinate,
sqrt(m - its squared norm), a query the coordinate 0: the squared distance is
then |q|^2 + m - 2 (q . v), a window of scores an annulus of distances, and the
best score the nearest row.

The search runs on one vantage-point tree whose upper part is fitted on a
bounded sample and sent to all tasks; its leaves are cells. Each row goes to its
cell, each cell to as many shards as its rows need (by row, so equal vectors
split too), and a shard grows its part of the tree. An anchor is sent only to
cells that its annulus meets. Before that the sample's rows give a bound for the
scores that still count. Within a shard leaves are taken nearest first, until
no closer row can be better than what is held. Scores decide exactly; ties go to
the smaller vec_id.

Rows with a null id, label or vector, an empty vector, or a null or non-finite
component take no part. Rows that share an id are rows of their own. Vectors of
another length than the anchor's have no score with it. Components' integers are
held within +-2**60 (see mtree.integers); a score beyond a long is the nearest long.
"""

from __future__ import annotations

import heapq
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .mtree import DIGITS, LONG, SLACK, integers
from .shared import cut
from .vptree import VPTree

SAMPLE = 4096  # rows that the upper part of the tree is fitted on
CELLS = 256  # at most; beyond, cells have more shards


def matrix(column, width: int, number) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a list column as a matrix filled up by zeros, their lengths)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), number)
    begin = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(begin, sizes)] = values if number is np.float64 else values.astype(object)
    return out, sizes


class Space:
    """How integer vectors become points, and scores distances."""

    def __init__(self, width: int, largest: float):
        self.width, self.largest = width, largest * (1 + 1e-9)
        # sums of products, a hundredfold, are exact in doubles up to here
        self.number = np.float64 if self.largest < 2.0**45 else object

    def points(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(float)
        return np.concatenate((x, np.sqrt(np.maximum(0, self.largest - (x**2).sum(1)))[:, None]), 1)

    def query(self, v: np.ndarray) -> np.ndarray:
        return np.append(v.astype(float), 0.0)

    def distances(self, q: np.ndarray, low: float, high: float) -> tuple[float, float]:
        """(near, far): what scores from low to high are at most apart, rounding included."""
        base = float((q**2).sum()) + self.largest
        loose = SLACK * math.sqrt(base) + SLACK
        near = 0.0 if high >= base / 2 else math.sqrt(base - 2 * float(high)) * (1 - SLACK) - loose
        far = math.inf if low == -math.inf else math.sqrt(max(0.0, base - 2 * float(low))) * (1 + SLACK) + loose
        return near, far


class Best:
    """The k best of (score, id, row): highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    def least(self, otherwise=-math.inf):
        return self.held[0][0] if len(self.held) >= self.k else otherwise

    def offer(self, scores, ids, rows) -> None:
        keep = scores >= self.least()
        for found in zip(scores[keep].tolist(), (-ids[keep]).tolist(), (-rows[keep]).tolist()):
            if len(self.held) < self.k:
                heapq.heappush(self.held, found)
            elif found > self.held[0]:
                heapq.heapreplace(self.held, found)

    def rows(self):
        return [(int(s), -i, -r) for s, i, r in self.held]


class Shard:
    """The rows of a shard: a tree over all, and one over each label that is asked for."""

    def __init__(self, space: Space, row, ids, labels, v, sizes, leaf: int):
        self.space, self.leaf = space, leaf
        self.row, self.ids, self.labels, self.v, self.sizes = row, ids, labels, v, sizes
        self.points = space.points(v)
        self.trees: dict = {}

    def _tree(self, label=None):
        if label not in self.trees:
            rows = np.arange(len(self.row)) if label is None else np.flatnonzero(self.labels == label)
            self.trees[label] = VPTree(self.points[rows], self.leaf), rows
        return self.trees[label]

    def positives(self, row, size, label, v, k: int, bound: float) -> Best:
        """The k best rows of the anchor's label but itself, none scoring below bound."""
        tree, rows = self._tree(label)
        q, best = self.space.query(v), Best(k)
        for page in tree.pages(q, 0.0, lambda: self.space.distances(q, max(bound, best.least()), math.inf)[1]):
            at = rows[page]
            at = at[(self.row[at] != row) & (self.sizes[at] == size)]
            best.offer(self.v[at] @ v, self.ids[at], self.row[at])
        return best

    def negatives(self, size, label, v, windows, k: int) -> list[Best]:
        """For each window (low, high) of scores the k best rows of another label."""
        tree, rows = self._tree()
        q, best = self.space.query(v), [Best(k) for _ in windows]
        near = self.space.distances(q, 0, max(h for _, h in windows))[0]
        wanted = lambda: min(max(low, b.least()) for (low, _), b in zip(windows, best))
        for page in tree.pages(q, near, lambda: self.space.distances(q, wanted(), math.inf)[1]):
            at = rows[page]
            at = at[(self.labels[at] != label) & (self.sizes[at] == size)]
            scores = self.v[at] @ v
            for (low, high), b in zip(windows, best):
                inside = (scores >= max(low, b.least())) & (scores <= high)
                if inside.any():
                    b.offer(scores[inside], self.ids[at[inside]], self.row[at[inside]])
        return best


def windows(scores, low: int, base: int):
    """(place, low, high): the windows low * positive <= base * negative <= base * positive that hold any score."""
    return [(i, -(-low * s // base), s) for i, s in enumerate(scores) if -(-low * s // base) <= s]


def mine(table: DataFrame, every: int = 100, positives: int = 5, k: int = 5, low: int = 80, base: int = 100, scale: int = 256, shard_rows: int = 8192, leaf: int = 512) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, embedding).

    Anchors are the rows whose id is divisible by `every`; the positives of each
    are its best other rows of the same label, as many as asked for or there are.
    """
    spark = table.sparkSession
    tb.ship(spark)
    plain = integers(table.where("label IS NOT NULL"), scale, "label")
    norm = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    n, width, largest = plain.select(F.size("v").alias("width"), norm.alias("norm")).agg(F.count("*"), F.max("width"), F.max("norm")).first()
    space = Space(width or 1, largest or 0.0)
    drawn = plain.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    cells = min(CELLS, max(1, -(-n // shard_rows)))
    v, sizes = matrix(drawn.column("v").combine_chunks(), space.width, space.number) if n else (np.zeros((0, space.width)), np.zeros(0, np.int64))
    sample = {"v": v, "sizes": sizes, "labels": drawn.column("label").to_numpy()}
    upper = VPTree(space.points(v), -(-len(v) // cells), whole_space=True)

    def to_cells(batches):
        for batch in batches:
            v, _ = matrix(batch.column("v"), space.width, space.number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upper.route(space.points(v)), pa.int32())], [*batch.schema.names, "cell"])

    rows = cut(plain.withColumn("row", F.monotonically_increasing_id()).mapInArrow(to_cells, f"vec_id long, v array<long>, label {plain.schema['label'].dataType.simpleString()}, row long, cell int"))
    shards = {r["cell"]: max(1, -(-r["n"] // shard_rows)) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    begin, total = {}, 0
    for cell in sorted(shards):
        begin[cell] = total
        total += shards[cell]
    ends = max(shards, default=0) + 1
    of = lambda d: F.element_at(F.array(*[F.lit(d.get(c, 1)) for c in range(ends)]), F.col("cell") + 1)
    shard = of(begin) + F.pmod(F.xxhash64("row"), of(shards)).cast("int")
    common = ["row", "vec_id", "label", "v"]
    data = rows.select(shard.alias("shard"), F.lit(0).alias("kind"), *common, F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<decimal(38,0)>").alias("scores"))
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)

    def send(batches):
        """Each anchor once to each shard of the cells its annulus meets, with what it has to look for."""
        for batch in batches:
            v, sizes = matrix(batch.column("v"), space.width, space.number)
            labels, scores = batch.column("label").to_numpy(), batch.column("scores").to_pylist()
            take, to, least = [], [], []
            for i in range(batch.num_rows):
                q = space.query(v[i])
                alike = (sample["labels"] == labels[i]) & (sample["sizes"] == sizes[i])
                if scores[i] is None:  # one more than asked for, as the anchor may be in the sample
                    known = sample["v"][alike] @ v[i]
                    bound = np.sort(known)[-positives - 1] if len(known) > positives else None
                    near, far = space.distances(q, -math.inf if bound is None else bound, math.inf)
                    bound = None if bound is None else [Decimal(int(bound))]
                else:
                    w = windows([int(s) for s in scores[i]], low, base)
                    if not w:
                        continue
                    near, far = space.distances(q, min(a for _, a, _ in w), max(b for _, _, b in w))
                    bound = scores[i]
                for cell in upper.leaves_within(q, near, far):
                    for s in range(begin.get(cell, 0), begin.get(cell, 0) + shards.get(cell, 0)):
                        take.append(i)
                        to.append(s)
                        least.append(bound)
            got = batch.take(pa.array(take, pa.int64()))
            named = dict(zip(batch.schema.names, got.columns))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array([1] * len(to), pa.int32()), *[named[c] for c in common], named["ids"], pa.array(least, pa.list_(pa.decimal128(38)))],
                ["shard", "kind", *common, "ids", "scores"],
            )

    def search(wanted, answer, schema):
        sent = wanted.mapInArrow(send, data.schema)
        dealt = data.union(sent).repartition(max(total, 1), "shard").sortWithinPartitions("shard", "kind")

        def run(batches):
            held, now, shard = [], None, None
            for batch in batches:
                s, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
                turn = np.flatnonzero((s[1:] != s[:-1]) | (kind[1:] != kind[:-1])) + 1
                out: list = []
                for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(s)]):
                    if a == b:
                        continue
                    if s[a] != now:
                        held, now, shard = [], s[a], None
                    part = batch.slice(a, b - a)
                    v, sizes = matrix(part.column("v"), space.width, space.number)
                    row, ids, labels = (part.column(c).to_numpy() for c in ("row", "vec_id", "label"))
                    if kind[a] == 0:
                        held.append((row, ids, labels, v, sizes))
                        continue
                    if shard is None and held:
                        shard = Shard(space, *[np.concatenate(x) for x in zip(*held)], leaf)
                        held = []
                    if shard is not None:
                        more = zip(part.column("ids").to_pylist(), part.column("scores").to_pylist())
                        for i, (pid, scores) in enumerate(more):
                            out += answer(shard, row[i].item(), ids[i].item(), labels[i].item(), v[i], int(sizes[i]), pid, scores)
                yield pa.RecordBatch.from_pylist(out, schema)

        return dealt.mapInArrow(run, ", ".join(f"{f.name} {'decimal(38,0)' if pa.types.is_decimal(f.type) else 'long'}" for f in schema))

    exact = lambda s: Decimal(max(-DIGITS, min(DIGITS, s)))

    def like(shard, row, vec_id, label, v, size, _, bound):
        best = shard.positives(row, size, label, v, positives, float(bound[0]) if bound else -math.inf)
        return [{"anchor": row, "id": i, "row": r, "score": exact(s)} for s, i, r in best.rows()]

    def unlike(shard, row, vec_id, label, v, size, pid, scores):
        w = windows([int(s) for s in scores], low, base)
        best = shard.negatives(size, label, v, [(a, b) for _, a, b in w], k)
        return [{"anchor_id": vec_id, "anchor": row, "place": i, "positive_id": pid[i], "positive_score": scores[i], "id": j, "row": r, "score": exact(s)} for (i, _, _), b in zip(w, best) for s, j, r in b.rows()]

    score, whole = ("score", pa.decimal128(38)), pa.int64()
    first = anchors.select(*common, F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<decimal(38,0)>").alias("scores"))
    found = search(first, like, pa.schema([("anchor", whole), ("id", whole), ("row", whole), score]))
    order = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row"))
    chosen = found.withColumn("k", order).where(F.col("k") <= positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("k", "id", "score"))).alias("p"))
    second = anchors.join(chosen, F.col("row") == F.col("anchor")).select(*common, F.col("p.id").alias("ids"), F.col("p.score").alias("scores"))
    found = search(cut(second), unlike, pa.schema([("anchor_id", whole), ("anchor", whole), ("place", whole), ("positive_id", whole), ("positive_score", pa.decimal128(38)), ("id", whole), ("row", whole), score]))
    order = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id", "row"))
    fits = lambda c: F.greatest(F.lit(-LONG - 1), F.least(F.lit(LONG), F.col(c))).cast("long")
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), fits("positive_score").alias("positive_score"), fits("score").alias("negative_score"))


def relabelled(table: DataFrame) -> DataFrame:
    """Labels of rows whose id is divisible by 7 become (label + 1) % 10."""
    return table.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.r AS a, q.vec_id AS anchor_id, e.label = q.label AS alike, e.r, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
      FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.r <> q.r AND len(e.v) = len(q.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) AS k FROM s WHERE alike) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id, s.r) AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
