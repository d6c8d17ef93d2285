"""Online variational Bayes for LDA whose word weights are a table, for vocabularies beyond one machine.

The updates are those of Spark's online optimizer (its defaults: a twentieth of
the documents a step, tau 1024, kappa 0.51, document weights fitted). The most
frequent words have numbers and their weights are broadcast; every other word's
start is told by its hash, and what steps add is a table of the words they met:
weight = scale * start + shift + added, where scale and shift are the same for
all words. Documents are kept as word numbers, and words without a number by
name. The driver has no more than the `head` most frequent words. Differences
from Spark's: a step takes documents by hash, without repetition, and a
document's inference begins at ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import folders
from ..ship import ship
from .graph import written

HEAD = 1 << 17
SHARE, TAU, KAPPA, SHAPE = 0.05, 1024, 0.51, 100.0
PAIRS = 1 << 18


def digamma(x):
    r = sum(1 / (x + i) for i in range(8))
    y = x + 8
    z = 1 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - r


def trigamma(x):
    r = sum(1 / (x + i) ** 2 for i in range(8))
    y = x + 8
    z = 1 / (y * y)
    return 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30))) + r


def expectation(x: np.ndarray) -> np.ndarray:
    """Of the logarithm of a Dirichlet variable; rows."""
    return digamma(x) - digamma(x.sum(-1, keepdims=True))


def start(term, k: int, seed: int):
    """A word's first weights: gamma variables of mean 1 (shape 100, by the cube of a normal one), from its hash."""
    unit = lambda *salt: (F.shiftrightunsigned(F.xxhash64(term, *map(F.lit, salt)), 11) + 0.5) / float(1 << 53)
    normal = lambda i: F.sqrt(-2 * F.log(unit(seed, i, 0))) * F.cos(2 * math.pi * unit(seed, i, 1))
    return F.array(*[F.pow(1 - 1 / (9 * SHAPE) + normal(i) / (3 * math.sqrt(SHAPE)), F.lit(3.0)) for i in range(k)])


def infer(w: np.ndarray, c: np.ndarray, size: np.ndarray, alpha: np.ndarray):
    """(gamma of each document, what each pair adds to its word).

    w: a row of exp(E[log beta]) for each pair of document and word, c: its count,
    size: the number of pairs of each document, one at least.
    """
    k = len(alpha)
    gamma, added = np.ones((len(size), k)), np.empty_like(w)
    live, rows, n = np.arange(len(size)), np.arange(len(c)), size
    mine, times = np.ascontiguousarray(w.T), c
    while len(live):
        first, g, settled = np.cumsum(n) - n, gamma[live], np.zeros(len(live), bool)
        theta = np.exp(expectation(g))

        def shares():
            """Of each topic in each pair, times the pair's count."""
            parts = [mine[i] * np.repeat(theta[:, i], n) for i in range(k)]
            t = times / (sum(parts) + 1e-100)
            return parts, t

        # documents go once a tenth of them have settled; those stay as they are meanwhile
        while settled.sum() * 10 < len(live):
            _, t = shares()
            new = theta * np.stack([np.add.reduceat(mine[i] * t, first) for i in range(k)], 1) + alpha
            more = np.abs(new - g).mean(1) > 1e-3
            g = np.where(settled[:, None], g, new)
            settled |= ~more
            theta = np.exp(expectation(g))
        parts, t = shares()
        over = np.repeat(settled, n)
        added[rows[over]] = np.stack([(x * t)[over] for x in parts], 1)
        gamma[live] = g
        live, rows, n = live[~settled], rows[~over], n[~settled]
        mine, times = mine[:, ~over], times[~over]
    return gamma, added


def term_counts(df: DataFrame, tokens: str) -> DataFrame:
    """(term, n)"""
    return df.select(F.explode(tokens).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))


class Topics:
    def __init__(self, df: DataFrame, k: int, tokens: str = "tokens", iterations: int = 5, seed: int = 1, head: int = HEAD, counted: DataFrame | None = None):
        """counted: (term, n), where it is there already."""
        self.spark, self.k, self.seed = df.sparkSession, k, seed
        ship(self.spark)
        counted = written(term_counts(df, tokens)) if counted is None else counted
        # the least count with no more than `head` words
        least, held = 1 << 62, 0
        for n, many in sorted(((r.n, r.many) for r in counted.groupBy("n").agg(F.count("*").alias("many")).collect()), reverse=True):
            if held + many > head:
                break
            least, held = n, held + many
        init = start(F.col("term"), k, seed)
        top = counted.where(F.col("n") >= least).select("term", init.alias("w")).toArrow().sort_by("term")
        self.names = top.column("term").combine_chunks()
        self.head0 = self._rows(top.column("w"))
        every = counted.select(init.alias("w")).agg(F.count("*"), *[F.sum(F.col("w")[i]) for i in range(k)]).first()
        self.vocabulary, self.sum0 = every[0], np.array([x or 0.0 for x in every[1:]])
        self.rest = counted.where(F.col("n") < least).select("term")
        self.docs = self._compact(df.select("id", F.col(tokens).alias("t")))
        self._fit(iterations)

    def _rows(self, column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.k)

    def _compact(self, df: DataFrame) -> DataFrame:
        """(row, id, codes, counts, tail): documents as numbers of words with their counts, and other words by name."""
        sent = self.spark.sparkContext.broadcast(self.names.to_pylist())

        def run(batches):
            names = pa.array(sent.value, pa.string())
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    lists = part.column("t")
                    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                    flat = lists.flatten().dictionary_encode()
                    use = flat.is_valid().to_numpy(zero_copy_only=False)
                    mine = flat.dictionary
                    code = pc.fill_null(pc.index_in(mine, value_set=names), -1).to_numpy().astype(np.int64)
                    # words without a number come last, by their place in the batch
                    other = np.flatnonzero(code < 0)
                    code[other] = len(names) + np.arange(len(other))
                    top = len(names) + len(other) + 1
                    x = code[pc.fill_null(flat.indices, 0).to_numpy()[use].astype(np.int64)] if len(mine) else np.zeros(0, np.int64)
                    key, n = np.unique(owner[use] * top + x, return_counts=True)
                    doc, x = key // top, key % top
                    lead = x < len(names)
                    cut = lambda d: pa.array(np.concatenate(([0], np.cumsum(np.bincount(d, minlength=len(lists))))).astype(np.int32))
                    n = n.astype(np.int32)
                    codes = pa.ListArray.from_arrays(cut(doc[lead]), pa.array(x[lead].astype(np.int32)))
                    counts = pa.ListArray.from_arrays(cut(doc[lead]), pa.array(n[lead]))
                    named = pa.StructArray.from_arrays([mine.take(pa.array(other[x[~lead] - len(names)])), pa.array(n[~lead])], ["term", "c"])
                    tail = pa.ListArray.from_arrays(cut(doc[~lead]), named)
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), codes, counts, tail], ["row", "id", "codes", "counts", "tail"])

        kind = df.schema["id"].dataType.simpleString()
        path = folders.scratch(self.spark, "topics")
        rows = df.select(F.monotonically_increasing_id().alias("row"), "id", "t")
        rows.mapInArrow(run, f"row long, id {kind}, codes array<int>, counts array<int>, tail array<struct<term:string,c:int>>").write.parquet(path)
        return self.spark.read.parquet(path)

    def _fit(self, iterations: int) -> None:
        k, many = self.k, self.docs.count()
        self.alpha, eta = np.full(k, 1 / k), 1 / k
        self.scale, self.shift, self.head = 1.0, 0.0, np.zeros_like(self.head0)
        self.added = self.spark.createDataFrame([], "term string, s array<double>")
        total = np.zeros(k)  # of what steps have added, over all words
        self._weigh(total)
        for step in range(1, iterations + 1):
            chosen = F.pmod(F.xxhash64("row", F.lit(self.seed), F.lit(step)), F.lit(1_000_000)) < int(SHARE * 1_000_000)
            found = written(self._inferred(self.docs.where(chosen), True))
            sums = [F.sum(F.col("stat")[i]).alias(f"s{i}") for i in range(k)]
            of_head = found.where("code >= 0").groupBy("code").agg(*sums).toArrow()
            about = found.where("code = -1").agg(F.sum("n"), *sums).first()
            docs = about[0] or 0
            if not docs:
                continue
            rho = (TAU + step) ** -KAPPA
            gain = rho * many / math.ceil(SHARE * many)
            stat = np.zeros_like(self.head)
            if of_head.num_rows:
                stat[of_head.column("code").to_numpy()] = np.stack([of_head.column(f"s{i}").to_numpy() for i in range(k)], 1)
            self.head = (1 - rho) * self.head + gain * stat
            tail = found.where("term IS NOT NULL").groupBy("term").agg(F.array(*[F.sum(F.col("stat")[i]) for i in range(k)]).alias("x"))
            s = lambda i: (1 - rho) * F.coalesce(F.col("s")[i], F.lit(0.0)) + gain * F.coalesce(F.col("x")[i], F.lit(0.0))
            self.added = written(self.added.join(tail, "term", "full").select("term", F.array(*[s(i) for i in range(k)]).alias("s")))
            self.scale, self.shift = (1 - rho) * self.scale, (1 - rho) * self.shift + rho * eta
            rest = self.added.agg(*[F.sum(F.col("s")[i]) for i in range(k)]).first()
            total = self.head.sum(0) + np.array([x or 0.0 for x in rest])
            self._alpha(rho, docs, np.array(about[1:], float) / docs)
            self._weigh(total)

    def _alpha(self, rho: float, docs: int, log_p: np.ndarray) -> None:
        """A step of Newton's method for the weights of topics in documents."""
        g = docs * (log_p - expectation(self.alpha))
        c, q = docs * trigamma(self.alpha.sum()), -docs * trigamma(self.alpha)
        b = (g / q).sum() / (1 / c + (1 / q).sum())
        new = self.alpha - rho * (g - b) / q
        if (new > 0).all():
            self.alpha = new

    def _weigh(self, total: np.ndarray) -> None:
        """The sums of weights of all words, as the head's weights need them."""
        self.all = digamma(self.scale * self.sum0 + self.shift * self.vocabulary + total)
        self.lead = np.exp(digamma(self.scale * self.head0 + self.shift + self.head) - self.all)

    def _weights(self, rows: DataFrame) -> DataFrame:
        """rows (term, ..) with the weights w of words that are not in the head."""
        init = start(F.col("term"), self.k, self.seed)
        s = F.coalesce("s", F.array(*[F.lit(0.0)] * self.k))
        return rows.join(self.added, "term", "left").withColumn("w", F.zip_with(init, s, lambda a, b: a * self.scale + self.shift + b)).drop("s")

    def _inferred(self, docs: DataFrame, stats: bool) -> DataFrame:
        """Either the sums of a step (code, term, n, stat), code -1 for the documents', or (id, topic)."""
        pairs = self._weights(docs.select("row", F.explode("tail").alias("x")).select("row", "x.term", "x.c"))
        pairs = pairs.groupBy("row").agg(F.collect_list(F.struct("term", "c", "w")).alias("named"))
        joined = docs.select("row", "id", "codes", "counts").join(pairs, "row", "left").select("id", "codes", "counts", "named")
        k, alpha, whole, base = self.k, self.alpha, self.all, len(self.names)
        sent = self.spark.sparkContext.broadcast(self.lead)

        def doubles(rows):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(rows).ravel()))

        def parts(batch):
            """Rows with some PAIRS pairs together."""
            named = batch.column("named")
            n = pc.fill_null(pc.list_value_length(batch.column("codes")), 0).to_numpy() + pc.fill_null(pc.list_value_length(named), 0).to_numpy()
            block = np.cumsum(n) // PAIRS
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(n)])) if len(n) else []
            for low, high in zip(cuts[:-1], cuts[1:]):
                yield batch.slice(low, high - low)

        def run(batches):
            lead = sent.value
            held, met = np.zeros((base, k)), np.zeros(base, bool)
            docs, log_p = 0, np.zeros(k)
            for whole_batch in batches:
                for batch in parts(whole_batch):
                    codes, counts, named = batch.column("codes"), batch.column("counts"), batch.column("named")
                    m = pc.fill_null(pc.list_value_length(named), 0).to_numpy()
                    n = pc.fill_null(pc.list_value_length(codes), 0).to_numpy()
                    x = codes.flatten().to_numpy().astype(np.int64)
                    other = named.flatten()
                    w = other.field("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if len(other) else np.zeros((0, k))
                    owner = np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)))
                    order = np.argsort(owner, kind="stable")
                    c = np.concatenate((counts.flatten().to_numpy(), other.field("c").to_numpy() if len(other) else np.zeros(0))).astype(float)
                    w = np.concatenate((lead[x], np.exp(digamma(w) - whole)))[order]
                    size = (n + m).astype(np.int64)
                    full = size > 0
                    gamma, added = infer(w, c[order], size[full], alpha) if full.any() else (np.zeros((0, k)), w)
                    if not stats:
                        topic = np.zeros(len(size), np.int64)
                        topic[full] = gamma.argmax(1) if len(gamma) else 0
                        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(topic)], ["id", "topic"])
                        continue
                    docs += int(full.sum())
                    log_p += expectation(gamma).sum(0) if len(gamma) else 0
                    back = np.empty_like(added)
                    back[order] = added
                    np.add.at(held, x, back[: len(x)])
                    met[x] = True
                    if len(other):
                        none = pa.nulls(len(other), pa.int32())
                        yield pa.RecordBatch.from_arrays([none, other.field("term"), pa.nulls(len(other), pa.int64()), doubles(back[len(x) :])], ["code", "term", "n", "stat"])
            if stats:
                at = np.flatnonzero(met)
                rows = np.concatenate((held[at], log_p[None, :]))
                n = pa.array([None] * len(at) + [docs], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1])).astype(np.int32)), pa.nulls(len(rows), pa.string()), n, doubles(rows)], ["code", "term", "n", "stat"])

        kind = docs.schema["id"].dataType.simpleString()
        return joined.mapInArrow(run, "code int, term string, n long, stat array<double>" if stats else f"id {kind}, topic long")

    def assigned(self) -> DataFrame:
        """(id, topic): the likeliest topic of each document; 0 for one without words."""
        return self._inferred(self.docs, False)

    def described(self, words: int) -> DataFrame:
        """(topic, terms): the words of the greatest weights of each topic."""
        lead = self.scale * self.head0 + self.shift + self.head
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1, dtype=np.int32) * self.k), pa.array(lead.ravel()))
        head = self.spark.createDataFrame(pa.table({"term": self.names, "w": flat}))
        each = head.unionByName(self._weights(self.rest)).select("term", F.posexplode("w").alias("topic", "weight"))
        order = [F.col("weight").desc(), F.col("term")]
        part = Window.partitionBy("topic", F.pmod(F.xxhash64("term"), F.lit(256))).orderBy(*order)
        best = each.withColumn("k", F.row_number().over(part)).where(F.col("k") <= words).withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).where(F.col("k") <= words)
        terms = F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"])
        return best.groupBy("topic").agg(terms.alias("terms"))
