"""Bigram language model in a log-frequency Bloom filter, sent to the tasks that score texts.

Counts are quantised on a logarithmic scale: a count n has the code
1 + floor(log(n) / log(BASE)). The filter holds, for every pair of neighbouring
tokens, for every context's count and for its number of different successors, one
entry for each code up to its own. A look-up asks for code 1, 2, ... until the
filter says no, and takes the middle of the counts that share the last code;
nothing is ever looked up too low, and too high with a chance of about
2 ** -HASHES for each code. Probabilities are Witten and Bell's:

    p(w | h) = (c(h w) + T(h) * p(w)) / (c(h) + T(h)),   p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

with c and T as looked up, N tokens and V distinct ones. A pair counts no more
than its context, and a context without counts leaves p(w).

Tokens are words (maximal runs of other characters than ASCII white space, A-Z
lower-cased) and one end for each text; a text's first context is its start.

Size. Pairs are counted in the map tasks, sent as sorted, delta-coded arrays to
one of 2**b buckets of about two million training tokens, and each bucket
becomes a segment of the filter in one task. A bucket holds whole contexts; the
contexts that make more than 1 / HOT of all tokens (at most HOT) are dealt over
all buckets by successor, and their counts go beside the filter. Segments are broadcast in
groups of at most `group_bytes`; beyond one group the texts are read once for
each group, with a few bytes per token carried along, so no task ever holds more.
Exact token counts (for the base score) never are in one place either: the
HEAD most frequent words are broadcast, rarer ones join by word.
Pairs are told by 64 bits (bucket, context, successor), words for the exact counts by 96.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import cut

U64 = np.uint64
BASE = 1.5
HASHES = 6
BITS = 1.5  # of the filter for a hash function's bit: about half of all bits are set then
HOT = 1024
HEAD = 1 << 18
BUCKET_TOKENS = 2_000_000
WORD_SLOTS, PAIR_SLOTS = 19, 20  # bits: answers of the filter that a worker remembers
HELD = 1 << 21  # distinct keys that a map task holds before it sends them

SECOND = tb.mix(np.arange(1001, 1257, dtype=U64) * U64(0xA24BAED4963EE407))
SECOND[65:91] = SECOND[97:123]
END, START = U64(0x5EED0E4D5EED0E4D), U64(0x57A2757A2757A275)
PAIR, COUNT, KINDS = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344), U64(0xA4093822299F31D0)


def code(n: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(n, 1)) / math.log(BASE) + 1e-9)).astype(np.int64) * (n > 0)


def _middles() -> np.ndarray:
    """The middle of the whole numbers that share a code; 0 for code 0."""
    low = np.ceil(BASE ** np.arange(0.0, 109.0) - 1e-6)
    high = np.append(low[1:] - 1, low[-1])
    return np.append(0.0, (low + np.maximum(low, high)) / 2)


MIDDLE = _middles()


def held_out(doc_id="doc_id"):
    """Texts that nothing is learnt from: crc32 of the id as text leaves 1 modulo 5; never those without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


class Tokens:
    """The tokens of a block of texts, an end after each text's words."""

    def __init__(self, block: tb.Block, second: bool = False):
        starts, ends, hashes, first = tb.words(block, tb.NOT_SPACE)
        self.hashes = np.insert(hashes, first[1:], END)
        self.first = first + np.arange(len(first))
        self.before = np.concatenate(([START], self.hashes[:-1])) if len(self.hashes) else self.hashes
        self.before[self.first[:-1]] = START
        if second:
            more = tb.span_hash(tb.prefix_sums(block.buf, SECOND), starts, ends) >> U64(33)
            self.more = np.insert(more, first[1:], 0)
        self._distinct = None

    def distinct(self):
        """(distinct hashes in order, the first place of each, each token's index in them)."""
        if self._distinct is None:
            words, at, back = np.unique(self.hashes, return_index=True, return_inverse=True)
            self._distinct = words, at, back.reshape(-1)
        return self._distinct


class Keys:
    """Names of pairs in 64 bits: bucket, context, successor."""

    def __init__(self, bits: int, hot: np.ndarray):
        self.bits, self.hot = bits, hot  # hot: sorted hashes
        self.low = (64 - bits) // 2
        self.middle = 64 - bits - self.low

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hot, words)
        return np.append(self.hot, U64(0))[at] == words if len(self.hot) else np.zeros(len(words), bool)

    def _top(self, x):
        return x >> U64(64 - self.bits) if self.bits else np.zeros(len(x), U64)

    def contexts(self, words: np.ndarray) -> np.ndarray:
        """Bucket and context; hot ones are without a bucket."""
        inner = (words << U64(self.bits)) >> U64(64 - self.middle)
        return np.where(self.is_hot(words), U64(0), self._top(words) << U64(self.middle)) | inner

    def pairs(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        spread = tb.mix(words)
        dealt = np.where(self.is_hot(before), self._top(spread) << U64(self.middle), U64(0))
        return ((self.contexts(before) | dealt) << U64(self.low)) | (spread & U64((1 << self.low) - 1))

    def bucket(self, pairs: np.ndarray) -> np.ndarray:
        return self._top(pairs).astype(np.int64)


class Counted:
    """Sorted keys with counts, gathered from many blocks."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merged(self):
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        self.parts, self.size = [(keys, counts)], len(keys)
        return keys, counts


def _halves(items: np.ndarray, level: int):
    h = tb.mix(items + U64((level * 0x9E3779B97F4A7C15) % 2**64))
    return h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)


def _place(a, b, i: int, bits):
    """The bit of the i-th hash function, for items of these halves, in filters of `bits` bits."""
    return (((a + U64(i) * b) & U64(0xFFFFFFFF)) * bits) >> U64(32)


def segment(items: np.ndarray, codes: np.ndarray, hashes: int = HASHES) -> tuple[int, bytes]:
    """(bits, filter) with an entry for every code up to an item's own."""
    bits = max(8, 8 * math.ceil(BITS * hashes * int(codes.sum()) / 8))
    flags = np.zeros(bits, bool)
    for level in range(1, int(codes.max(initial=0)) + 1):
        a, b = _halves(items[codes >= level], level)
        for i in range(hashes):
            flags[_place(a, b, i, U64(bits))] = True
    return bits, np.packbits(flags).tobytes()


class Remembered:
    """Answers for items asked before, one in each slot; the one with the greater first code stays, as it took the most probes."""

    def __init__(self, bits: int):
        self.bits = bits
        self.items = np.zeros(1 << bits, U64)
        self.items[0] = 1  # 0 belongs into slot 0, 1 does not
        self.codes: list[np.ndarray] = []

    def look_up(self, items: np.ndarray, ask) -> np.ndarray:
        """The rows of ask(indices) for all items, which are distinct."""
        slot = ((items * U64(tb.BASE)) >> U64(64 - self.bits)).astype(np.int64)
        other = np.flatnonzero(self.items[slot] != items)
        if not self.codes:
            found = ask(other)
            self.codes = [np.zeros(1 << self.bits, np.uint8) for _ in found]
        elif len(other):
            found = ask(other)
        out = np.stack([c[slot] for c in self.codes])
        if len(other):
            out[:, other] = found
            better = np.flatnonzero(found[0] >= self.codes[0][slot[other]])
            at, mine = slot[other[better]], items[other[better]]
            self.items[at] = mine
            stay = self.items[at] == mine  # of two for a slot
            for c, row in zip(self.codes, found):
                c[at[stay]] = row[better[stay]]
        return out


class Group:
    """Segments of the filter that are in memory together."""

    def __init__(self, buckets: int, rows, hashes: int = HASHES):
        """rows: (bucket, bits, filter)."""
        self.hashes = hashes
        self.bits = np.zeros(buckets, U64)
        self.begin = np.zeros(buckets, np.int64)
        parts, at = [], 0
        for bucket, bits, data in rows:
            self.bits[bucket], self.begin[bucket] = bits, at
            parts.append(np.frombuffer(data, np.uint8))
            at += len(data)
        self.data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        self.memory: dict[str, Remembered] = {}  # of the worker that has the group

    def remembered(self, items: np.ndarray, name: str, slot_bits: int, ask) -> np.ndarray:
        """ask(indices of items), with what was asked under this name before answered from memory."""
        if name not in self.memory:
            self.memory[name] = Remembered(slot_bits)
        return self.memory[name].look_up(items, ask)

    def look_up(self, items: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The codes of items; 0 also where the bucket is in another group. Fastest where the buckets ascend."""
        out = np.zeros(len(items), np.uint8)
        live = np.flatnonzero(self.bits[bucket] > 0)
        level = 1
        while len(live) and level < 255:
            a, b = _halves(items[live], level)
            bits, begin = self.bits[bucket[live]], self.begin[bucket[live]]
            held = None  # of these, those that no hash function has ruled out; those ruled out go once they are a quarter
            for i in range(self.hashes):
                place = _place(a, b, i, bits).astype(np.int64)
                yes = ((self.data[begin + (place >> 3)] << (place & 7).astype(np.uint8)) & 128).view(bool)
                held = yes if held is None else held & yes
                if i + 1 == self.hashes:
                    live = live[held]
                elif 4 * np.count_nonzero(held) < 3 * len(held):
                    live, a, b, bits, begin = live[held], a[held], b[held], bits[held], begin[held]
                    held = None
            out[live] = level
            level += 1
        return out


def _planes(values: np.ndarray) -> bytes:
    """Little-endian bytes, the first of all values, then the second of all, and so on."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


class BloomLM:
    """The model of `texts` (column text; null: empty), fitted at once; score() is lazy but for its passes."""

    def __init__(self, texts: DataFrame, group_bytes: int = 128 << 20, head: int = HEAD, hashes: int = HASHES, bucket_tokens: int = BUCKET_TOKENS):
        self.spark, self.hashes = texts.sparkSession, hashes
        tb.ship(self.spark)
        texts = texts.select("text")
        self.vocabulary = cut(self._count_words(texts).groupBy("a", "b").agg(F.sum("n").alias("n")))
        self.tokens, self.types = (x or 0 for x in self.vocabulary.agg(F.sum("n"), F.count("*")).first())
        end = self.vocabulary.where(F.col("a") == int(END.astype(np.int64))).agg(F.max("n")).first()[0]
        self.ends = end or 0
        frequent = self.vocabulary.where((F.col("n") * HOT >= self.tokens) & (F.col("a") != int(END.astype(np.int64)))).select("a", "n").toArrow()
        # counts of hot contexts, the start among them
        words = np.append(frequent.column("a").to_numpy().astype(np.int64).view(U64), START)
        counts = np.append(frequent.column("n").to_numpy(), self.ends)
        order = np.argsort(words)
        self.hot, self.hot_counts = words[order], counts[order].astype(float)
        self.keys = Keys(max(0, math.ceil(math.log2(max(1, self.tokens / bucket_tokens)))), self.hot)
        self._head(head)
        self._fit(texts, group_bytes)

    def _count_words(self, texts):
        def run(batches):
            held, names, size = [], None, 0

            def send():
                a, b, n = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((b, a))
                a, b, n = a[order], b[order], n[order]
                at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                return a[at], b[at], np.add.reduceat(n, at)

            def rows(a, b, n):
                return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

            for batch in batches:
                for block in tb.blocks(batch.column(0)):
                    t = Tokens(block, second=True)
                    distinct, at, n = np.unique(t.hashes, return_index=True, return_counts=True)
                    held.append((distinct, t.more[at], n))
                    size += len(distinct)
                    if size > 2 * HELD:
                        held = [send()]
                        size = len(held[0][0])
                        if size > HELD:
                            yield rows(*held[0])
                            held, size = [], 0
            if held:
                yield rows(*send())

        return texts.mapInArrow(run, "a long, b int, n long")

    def _head(self, most: int) -> None:
        """The most frequent words, whole classes of counts by powers of two, at most `most`."""
        classes = {r["c"]: r["n"] for r in self.vocabulary.groupBy(F.floor(F.log2("n")).cast("int").alias("c")).agg(F.count("*").alias("n")).collect()}
        least, total = 64, 0
        for c in sorted(classes, reverse=True):
            total += classes[c]
            if total > most:
                break
            least = c
        self.least = 1 << min(least, 62)
        found = self.vocabulary.where(F.col("n") >= self.least).toArrow()
        a, b, n = (found.column(c).to_numpy() for c in ("a", "b", "n"))
        a = a.astype(np.int64).view(U64)
        order = np.argsort(a)
        self.head = a[order], b[order].astype(np.int64), n[order].astype(np.int64)

    def _fit(self, texts, group_bytes):
        keys, buckets, hashes = self.keys, 1 << self.keys.bits, self.hashes
        hot = keys.contexts(self.hot)
        hot_order = np.argsort(hot)
        sorted_hot = hot[hot_order]

        def count(batches):
            counted = Counted()

            def rows():
                found, n = counted.merged()
                bucket = keys.bucket(found)
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                out = []
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    k = found[edge[i] : edge[i + 1]]
                    out.append({"bucket": i, "keys": _planes(np.diff(k, prepend=U64(0))), "n": _planes(n[edge[i] : edge[i + 1]])})
                return pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())]))

            for batch in batches:
                for block in tb.blocks(batch.column(0)):
                    t = Tokens(block)
                    counted.add(*np.unique(keys.pairs(t.before, t.hashes), return_counts=True))
                    if counted.size > 2 * HELD:
                        counted.merged()
                        if counted.size > HELD:
                            yield rows()
                            counted = Counted()
            if counted.size:
                yield rows()

        def build(batches):
            schema = pa.schema([("bucket", pa.int32()), ("bits", pa.int64()), ("filter", pa.binary()), ("kinds", pa.list_(pa.int64()))])

            def made(bucket, counted):
                pairs, n = counted.merged()
                context = pairs >> U64(keys.low)
                at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                context, total, kinds = context[at], np.add.reduceat(n, at), np.diff(np.append(at, len(pairs)))
                bare = context & U64((1 << keys.middle) - 1)
                place = np.minimum(np.searchsorted(sorted_hot, bare), len(sorted_hot) - 1)
                is_hot = sorted_hot[place] == bare
                mine = np.zeros(len(sorted_hot), np.int64)
                mine[hot_order[place[is_hot]]] = kinds[is_hot]
                rest = context[~is_hot]
                items = np.concatenate((pairs ^ PAIR, rest ^ COUNT, tb.mix(rest ^ KINDS)))
                bits, data = segment(items, np.concatenate((code(n), code(total[~is_hot]), code(kinds[~is_hot]))), hashes)
                return pa.RecordBatch.from_pylist([{"bucket": bucket, "bits": bits, "filter": data, "kinds": mine.tolist()}], schema)

            now, counted = None, None
            for batch in batches:
                for bucket, k, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "n"))):
                    if bucket != now:
                        if counted is not None:
                            yield made(now, counted)
                        now, counted = bucket, Counted()
                    counted.add(np.cumsum(_unplaned(k, U64), dtype=U64), _unplaned(n, np.int64))
                    if len(counted.parts) > 1 and counted.size > 4 * HELD:
                        counted.merged()
            if counted is not None:
                yield made(now, counted)

        sent = texts.mapInArrow(count, "bucket int, keys binary, n binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
        self.segments = cut(sent.mapInArrow(build, "bucket int, bits long, filter binary, kinds array<long>"))
        kinds = self.segments.select(F.posexplode("kinds").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
        self.hot_kinds = np.zeros(len(self.hot))
        for r in kinds:
            self.hot_kinds[r["at"]] = r["n"]
        sizes = sorted((r["bucket"], r["bits"] // 8) for r in self.segments.select("bucket", "bits").collect())
        self.groups, held = [[]], 0
        for bucket, size in sizes:
            if held + size > group_bytes and self.groups[-1]:
                self.groups.append([])
                held = 0
            self.groups[-1].append(bucket)
            held += size

    def _group(self, buckets) -> Group:
        if not buckets:
            return Group(1 << self.keys.bits, [], self.hashes)
        found = self.segments.where(F.col("bucket").between(buckets[0], buckets[-1])).select("bucket", "bits", "filter").orderBy("bucket").toArrow()
        return Group(1 << self.keys.bits, zip(*(found.column(c).to_pylist() for c in ("bucket", "bits", "filter"))), self.hashes)

    def score(self, docs: DataFrame, *more: str) -> DataFrame:
        """(more columns, n_tokens, n_known, train_tokens, base_score, score) of each row's text."""
        keep = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)]
        rows = docs.select(*keep, F.col("text").alias("text"), F.lit(None).cast("binary").alias("codes"))
        for place, buckets in enumerate(self.groups):
            sent = self.spark.sparkContext.broadcast(self._group(buckets))
            last = place == len(self.groups) - 1
            rows = self._pass(rows, len(more), sent, last)
            rows = cut(rows.withColumn("row", F.monotonically_increasing_id())) if last else cut(rows)
            sent.destroy()
        named = [F.col(f"c{i}").alias(c) for i, c in enumerate(more)]
        final = [F.col("n_tokens"), F.col("n_known"), F.lit(self.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("score")]
        # words outside of the head join the counts by word; rows without such words do not
        rare = rows.where(F.size("rare") > 0).select("row", F.explode("rare").alias("w")).select("row", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.n").alias("times"))
        known = rare.join(self.vocabulary.where(F.col("n") < self.least), ["a", "b"], "left")
        c = F.coalesce(F.col("n"), F.lit(0)).cast("double")
        term = F.col("times") * F.log10((c + 0.5) / F.lit(self.tokens + 0.5 * (self.types + 1)))
        sums = known.groupBy("row").agg(F.sum(term).alias("more_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
        bare = rows.drop("rare")
        with_rare = bare.where("has_rare").join(sums, "row").withColumn("base", F.col("base") + F.col("more_base")).withColumn("n_known", F.col("n_known") + F.col("more_known"))
        return bare.where("NOT has_rare").select(*named, *final).unionAll(with_rare.select(*named, *final))

    def _pass(self, rows: DataFrame, columns: int, sent, last: bool) -> DataFrame:
        """Looks up one group; the last pass turns codes into scores."""
        keys, hot_counts, hot_kinds = self.keys, self.hot_counts, self.hot_kinds
        head_a, head_b, head_n = self.head
        every = self.tokens + 0.5 * (self.types + 1)
        ends = float(self.ends)
        front = rows.schema.fields[:columns]

        def codes_of(t: Tokens, group: Group, known):
            words, _, back = t.distinct()
            context = keys.contexts(words)  # ascend with the words, but for hot ones
            plain = np.flatnonzero(~keys.is_hot(words) & (words != END))
            context, of_words = context[plain], np.zeros((2, len(words)), np.uint8)
            bucket = keys.bucket(context << U64(keys.low))
            of_words[:, plain] = group.remembered(context, "words", WORD_SLOTS, lambda i: np.stack((group.look_up(context[i] ^ COUNT, bucket[i]), group.look_up(tb.mix(context[i] ^ KINDS), bucket[i]))))
            # a bucket's look-ups together: its segment stays in the processor's cache
            pairs, where = np.unique(keys.pairs(t.before, t.hashes), return_inverse=True)
            of_pairs = group.remembered(pairs, "pairs", PAIR_SLOTS, lambda i: group.look_up(pairs[i] ^ PAIR, keys.bucket(pairs[i]))[np.newaxis])
            found = np.concatenate((of_words[:, back], of_pairs[:, where.reshape(-1)]))
            return np.maximum(found, known) if known is not None else found

        def run(batches):
            group = sent.value
            for batch in batches:
                at = batch.schema.names.index("text")
                for block in tb.blocks(batch.column(at)):
                    part = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                    t = Tokens(block, second=last)
                    sizes = np.diff(t.first)
                    before = [np.frombuffer(x, np.uint8).reshape(3, -1) for x in part.column(at + 1).to_pylist() if x is not None]
                    codes = codes_of(t, group, np.concatenate(before, 1) if before else None)
                    if not last:
                        cuts = t.first.tolist()
                        data = [codes[:, a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                        yield pa.RecordBatch.from_arrays([*part.columns[: at + 1], pa.array(data, pa.binary())], batch.schema.names)
                        continue
                    yield scored(part.columns[:columns], t, sizes, codes)

        def scored(kept, t, sizes, codes):
            own = np.searchsorted(keys.hot, t.hashes)
            hot = keys.is_hot(t.hashes)
            own = np.where(hot, own, 0)
            c = np.where(hot, hot_counts[own], MIDDLE[codes[0]])
            c = np.where(t.hashes == END, ends, c)
            k = np.minimum(np.where(hot, hot_kinds[own], MIDDLE[codes[1]]), c)
            p = (c + 0.5) / every
            start = int(np.searchsorted(keys.hot, START))
            ahead = lambda x, first: np.where(t.before == START, first, np.append(0.0, x[:-1]))  # noqa: E731  of each token's context
            n, kinds = ahead(c, hot_counts[start]), ahead(k, hot_kinds[start])
            both = np.minimum(MIDDLE[codes[2]], n)
            kinds = np.where(n > 0, np.maximum(kinds, 1), 0)
            p = np.where(n > 0, (both + kinds * p) / np.maximum(n + kinds, 1), p)
            score = tb.segment_sums(np.log10(p), t.first)
            # exact counts of the head's words
            words, where, back = t.distinct()
            place = np.minimum(np.searchsorted(head_a, words), max(len(head_a) - 1, 0))
            known = (head_a[place] == words) & (head_b[place] == t.more[where]) if len(head_a) else np.zeros(len(words), bool)
            exact = np.where(known, head_n[place], 0) if len(head_a) else np.zeros(len(words), np.int64)
            inside = known[back]
            base = tb.segment_sums(np.where(inside, np.log10((exact[back] + 0.5) / every), 0.0), t.first)
            # others by text and word
            rest = np.flatnonzero(~inside)
            text = np.repeat(np.arange(len(sizes)), sizes)[rest]
            order = np.lexsort((t.hashes[rest], text))
            rest, text = rest[order], text[order]
            word = t.hashes[rest]
            new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (text[1:] != text[:-1]))) if len(rest) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(rest)))
            rare = pa.StructArray.from_arrays([pa.array(word[new].view(np.int64)), pa.array(t.more[rest[new]].astype(np.int32)), pa.array(times.astype(np.int32))], ["a", "b", "n"])
            cuts = np.searchsorted(text[new], np.arange(len(sizes) + 1)).astype(np.int32)
            arrays = [pa.array(sizes.astype(np.int64)), pa.array(tb.segment_sums(inside.astype(np.int64), t.first)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(cuts), rare), pa.array(np.diff(cuts) > 0)]
            return pa.RecordBatch.from_arrays([*kept, *arrays], [*[f.name for f in front], "n_tokens", "n_known", "base", "score", "rare", "has_rare"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in front) + ", " * bool(front)
        made = "n_tokens long, n_known long, base double, score double, rare array<struct<a: long, b: int, n: int>>, has_rare boolean"
        return rows.mapInArrow(run, fields + (made if last else "text string, codes binary"))


def report(docs: DataFrame) -> DataFrame:
    """Every text's score by a model of the texts that are not held out; see held_out.

    Null texts are empty: one token, the end. Equal texts have equal scores.
    Without training texts every probability is 1 (log 0).
    """
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return BloomLM(rows.where("NOT held_out")).score(rows, "doc_id", "held_out")
