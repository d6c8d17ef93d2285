"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds the hashes (54 bits) of its distinct word n-grams.
Equal sets form one class; everything below works on classes, so copies cost
one row each. Set sizes are cut into bands; two sets that can be similar enough
lie in the same or in neighbouring bands, so each set signs its own band and,
where a partner can be there, the next one. Within a band of largest size r the
sets differ in at most k = 2r(1-t)/(1+t) elements. The domain is hashed into
more than k/2 first-level partitions, so some partition differs in at most one
element; each is split in three, and the sums of the elements in every two of
the three are signatures. So linked sets share a signature, always.

Signatures of partitions without elements would be shared by strangers. They
are left out as long as a set has enough filled partitions that the argument
holds without them; else the set signs again under another hash, and under the
last one with the empty ones too. Either set of a pair having enough suffices.

Groups of classes with one signature are written once however many signatures
they share. First come some turns over a quarter of the groups each. In the
first, one class of a group is compared with all others; in the next, each
component that a group still has is compared with another one by its nearest
pair, so they merge as in Boruvka's algorithm. This finds most components at
little cost. Then, over all groups that still hold several components, classes
of different components are compared (pairs within one would change no
component), which misses nothing. A pair is compared text against text, but only
if its odd sketches allow it: a sketch has a bit for each cell of a hash of the
domain, set if the set has an odd number of elements there, so two sets differ in
at least as many elements as their sketches differ in bits. The turns use two to
four bits an element. What they leave is mostly sets that are nearly similar
enough and meet in many groups; for the last comparison these get sketches of
FINE times as many bits, so that few pairs but the linked ones are left.

Memberships travel as two numbers; sketches join them only for the groups that a
turn compares. A large group is dealt in blocks: each block meets the group's first class in the
first turn, and each other block later.

Null and wordless texts have the empty set and are linked with nothing. Texts
with fewer than n words have all their words as one element. A document may
come twice under one doc_id; such rows share a class only if their sets agree.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import components, cut

U = np.uint64
HASH_BITS = 54
SEEDS = 4
SALTS = 16
TURNS = 4
FIRST_SPLIT = 512  # classes of a group in one task in the first turn, where a further block takes one row more
SPLIT = 2048  # and later, where it takes all rows of the group once more
FINE = 2
FEW = 500_000  # labels that are sent to every task; more go through a shuffle
BAND = 1.4  # about how much larger the largest set of a band is than its smallest


def shingle_sets(block: tb.Block, n: int):
    """(sorted distinct hashes, first): the set of document i is hashes[first[i]:first[i + 1]]."""
    _, _, h, word = tb.words(block, tb.NOT_SPACE)
    count = np.diff(word)
    whole = np.minimum(count, n)  # words in each shingle
    at = tb.ranges(word[:-1], np.where(count > 0, np.maximum(count - n + 1, 1), 0))
    doc = np.repeat(np.arange(len(block)), np.where(count > 0, np.maximum(count - n + 1, 1), 0))
    s = np.zeros(len(at), U)
    size = whole[doc]
    for j in range(n):
        inside = size > j
        s[inside] = s[inside] * U(tb.BASE) + h[at[inside] + j]
    s = tb.mix(s + size.astype(U)) >> U(64 - HASH_BITS)
    key = np.sort((doc.astype(U) << U(HASH_BITS)) | s)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    owner = (key >> U(HASH_BITS)).astype(np.int64)
    return key & U((1 << HASH_BITS) - 1), np.searchsorted(owner, np.arange(len(block) + 1))


def _set_keys(hashes, first):
    return (tb.segment_sums(tb.mix(hashes), first) + tb.mix(np.diff(first).astype(U))).view(np.int64)


class Bands:
    """Size bands and partition counts for a similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high = [1], []
        while self.low[-1] < 1 << 40:
            high = self.low[-1]
            for _ in range(max(1, int(log(BAND) / log(den / num)))):
                high = max(high, high * den // num)
            self.high.append(high)
            self.low.append(high + 1)
        self.high = np.array(self.high)
        self.low = np.array(self.low[:-1])
        # Jaccard >= t means a symmetric difference of at most (1-t)/(1+t) of the sizes' sum.
        self.k = (2 * self.high * (den - num)) // (den + num)
        self.need = self.k // 2 + 1
        # so many more that the smallest sets signed here have enough filled ones, but for about one in forty
        least = np.maximum(1, self.low * num // den)
        parts = (self.need + 1).astype(float)
        for _ in range(8):
            mean = least / parts
            unfilled = np.clip(3 * np.exp(-2 * mean / 3) - 2 * np.exp(-mean), 0, 0.5)
            parts = np.ceil((self.need + 1 + 2 * np.sqrt(self.need * unfilled)) / (1 - unfilled))
        self.parts = np.where(self.k == 0, 1, parts.astype(np.int64))

    def of(self, size):
        return np.searchsorted(self.high, size)


def _sign(hashes, first, band, bands: Bands, seed: int, empty: bool):
    """(signatures, owner, enough): of sets all taken at the given bands."""
    parts = bands.parts[band]
    base = np.concatenate(([0], np.cumsum(3 * parts)))
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    m = tb.mix(hashes + U(0x1000003 * (seed + 1)))
    cell = base[owner] + (((m >> U(32)) * (3 * parts)[owner].astype(U)) >> U(32)).astype(np.int64)
    value = tb.mix(m)
    total = int(base[-1])
    low = np.bincount(cell, weights=(value & U(0xFFFFFFFF)).astype(np.float64), minlength=total)
    high = np.bincount(cell, weights=(value >> U(32)).astype(np.float64), minlength=total)
    sums = (low.astype(U) + (high.astype(U) << U(32))).reshape(-1, 3)
    filled = np.bincount(cell, minlength=total).reshape(-1, 3) > 0
    whose = np.repeat(np.arange(len(n)), parts)
    good = filled.sum(1) >= 2
    exact = bands.k[band] == 0  # one signature: the whole set
    enough = exact | (np.bincount(whose, weights=good, minlength=len(n)) >= bands.need[band])
    part = np.arange(len(whose)) - (base[:-1] // 3)[whose]
    out, owners = [], []
    tag = tb.mix((band[whose] * SEEDS + seed).astype(U) * U(1 << 32) + part.astype(U))
    for drop in range(3):
        a, b = [x for x in range(3) if x != drop]
        keep = ~exact[whose] & (filled[:, a] | filled[:, b] | empty)
        out.append(tb.mix(sums[keep, a] + sums[keep, b] + tag[keep] * U(2 * drop + 1)))
        owners.append(whose[keep])
    one = exact[whose]
    out.append(tb.mix(sums[one].sum(1, dtype=U) + tag[one]))
    owners.append(whose[one])
    return np.concatenate(out).view(np.int64), np.concatenate(owners), enough


def _pick(hashes, first, rows):
    n = np.diff(first)[rows]
    return hashes[tb.ranges(first[:-1][rows], n)], np.concatenate(([0], np.cumsum(n)))


def signatures(hashes, first, bands: Bands):
    """(signatures, index of the set) for every set that isn't empty."""
    size = np.diff(first)
    band = bands.of(size)
    out, owners = [], []
    for ahead in (0, 1):
        rows = np.flatnonzero(size > 0)
        if ahead:  # a partner in the next band is no larger than size * den / num
            rows = rows[size[rows] * bands.den // bands.num >= bands.low[band[rows] + 1]]
        for seed in range(SEEDS):
            if not len(rows):
                break
            h, f = _pick(hashes, first, rows)
            s, o, enough = _sign(h, f, band[rows] + ahead, bands, seed, empty=seed == SEEDS - 1)
            out.append(s)
            owners.append(rows[o])
            rows = rows[~enough]
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def _groups(sorted_keys: np.ndarray):
    """Starts and ends of runs of at least two equal values."""
    change = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    starts = np.concatenate(([0], change))
    ends = np.concatenate((change, [len(sorted_keys)]))
    more = ends - starts > 1
    return starts[more], ends[more]


def _whole_groups(batches, key: str):
    """Tables of whole groups from batches sorted by key: a group is never split between two."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut_at = int(np.searchsorted(keys, keys[-1]))
        if cut_at or (held and held[-1].column(key)[-1].as_py() != keys[0]):
            ready = pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            if ready.num_rows:
                yield ready
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)


def odd_sketches(hashes, first, fine: int = 1) -> pa.Array:
    """A bit vector for each set: 2**j cells, j by size and `fine` alone, a cell is 1 if it has an odd number of elements."""
    n = np.diff(first)
    log = np.maximum(6, np.ceil(np.log2(np.maximum(1, 2 * fine * n))).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(1 << log)))
    cell = (tb.mix(hashes + U(0xABCDEF)) & ((U(1) << log.astype(U)) - U(1))[np.repeat(np.arange(len(n)), n)]).astype(np.int64)
    count = np.bincount(np.repeat(base[:-1], n) + cell, minlength=int(base[-1]))
    bits = np.packbits((count & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(bits)])


class Sketches:
    """Distances of the odd sketches in a column; a larger one is folded to the other's cells."""

    def __init__(self, column: pa.ChunkedArray):
        raw, off = tb.flat_bytes(column)
        self.words = raw.view(U) if len(raw) else np.zeros(0, U)
        self.start, self.size = off[:-1] // 8, np.diff(off) // 8

    def coarse(self, times: int) -> "Sketches":
        """The same folded to 1 / times of the bits, one word at least."""
        out = object.__new__(Sketches)
        out.size = np.maximum(1, self.size // times)
        out.start = np.cumsum(out.size) - out.size
        out.words = np.zeros(int(out.size.sum()), U)
        for w in np.unique(out.size):
            rows = np.flatnonzero(out.size == w)
            out.words[out.start[rows][:, None] + np.arange(w)] = self._at(rows, int(w))
        return out

    def _at(self, rows, width):
        out = np.zeros((len(rows), width), U)
        size = self.size[rows]
        for s in np.unique(size):
            mine = size == s
            got = self.words[self.start[rows[mine]][:, None] + np.arange(s)]
            out[mine] = np.bitwise_xor.reduce(got.reshape(len(got), s // width, width), axis=1)
        return out

    def differ(self, a, b) -> np.ndarray:
        """Bits that the sketches of rows a[i] and b[i] differ in."""
        out = np.zeros(len(a), np.int64)
        width = np.minimum(self.size[a], self.size[b])
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            step = max(1, (1 << 20) // int(w))
            for at in range(0, len(rows), step):
                r = rows[at : at + step]
                out[r] = np.bitwise_count(self._at(a[r], w) ^ self._at(b[r], w)).sum(1)
        return out


class JaccardJoin:
    """The join of a table of documents with itself; similarity at least num / den on word n-grams."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100):
        self.spark, self.n, self.bands = docs.sparkSession, n, Bands(num, den)
        tb.ship(self.spark)
        self.docs = docs.select("doc_id", "text")
        self.named = docs.select("doc_id", "text", _name().alias("name"))
        self._linked = None

    def sets(self) -> DataFrame:
        """(doc_id, name, n_shingles, set_key, sketch) of every row; name tells rows of one doc_id apart by their texts."""
        n = self.n

        def run(batches):
            for batch in batches:
                for block in tb.blocks(batch.column("text")):
                    h, first = shingle_sets(block, n)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(block.rows.start, len(block)) for c in ("doc_id", "name")), pa.array(np.diff(first)), pa.array(_set_keys(h, first)), odd_sketches(h, first)],
                        ["doc_id", "name", "n_shingles", "set_key", "sketch"],
                    )

        return self.named.mapInArrow(run, "doc_id long, name long, n_shingles long, set_key long, sketch binary")

    def signed(self) -> DataFrame:
        """(sig, set_key) of every set; a task signs equal sets once."""
        n, bands = self.n, self.bands

        def run(batches):
            seen: set[int] = set()
            for batch in batches:
                for block in tb.blocks(batch.column("text")):
                    h, first = shingle_sets(block, n)
                    keys = _set_keys(h, first)
                    new = [i for i, k in enumerate(keys.tolist()) if not (k in seen or seen.add(k))]
                    h, first = _pick(h, first, np.array(new, np.int64))
                    sig, owner = signatures(h, first, bands)
                    yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(keys[new][owner])], ["sig", "set_key"])

        return self.docs.mapInArrow(run, "sig long, set_key long")

    def shared(self) -> DataFrame:
        """(grp, set_key, n): the different groups of at least two sets with one signature; n: the sets of the group."""

        def run(batches):
            for t in _whole_groups(batches, "sig"):
                sig, key = (t.column(c).to_numpy() for c in ("sig", "set_key"))
                first = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
                sig, key = sig[first], key[first]
                a, b = _groups(sig)
                at = tb.ranges(a, b - a)
                name = tb.segment_sums(tb.mix(key[at].view(U)), np.concatenate(([0], np.cumsum(b - a))))
                new = np.isin(np.arange(len(name)), np.unique(name, return_index=True)[1])
                name, a, n = name[new], a[new], (b - a)[new]
                at = tb.ranges(a, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, n).view(np.int64)), pa.array(key[at]), pa.array(np.repeat(n, n).astype(np.int32))], ["grp", "set_key", "n"])

        dealt = self.signed().repartition("sig").sortWithinPartitions("sig", "set_key")
        return dealt.mapInArrow(run, "grp long, set_key long, n int").distinct()

    def _dealt(self, rows: DataFrame, first: bool) -> DataFrame:
        """rows with `part` and `side`: what one task compares. Sets of part are compared if their sides differ or are 2."""
        most = FIRST_SPLIT if first else SPLIT
        few = rows.where(F.col("n") <= most).select(F.col("grp").alias("part"), F.lit(2).alias("side"), "set_key", "label")
        many = rows.where(F.col("n") > most).withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
        many = many.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        if first:  # the smallest set meets every block
            hub = many.groupBy("grp").agg(F.min("set_key").alias("set_key")).withColumn("hub", F.lit(True))
            many = many.join(hub, ["grp", "set_key"], "left").withColumn("to", F.explode(F.when(F.col("hub"), others).otherwise(F.array("block"))))
            part, side = F.xxhash64("grp", "to"), F.lit(2)
        else:
            many = many.withColumn("to", F.explode(others))
            part = F.xxhash64("grp", F.least("block", "to"), F.greatest("block", "to"))
            side = F.when(F.col("block") == F.col("to"), 2).otherwise((F.col("block") > F.col("to")).cast("int"))
        return few.union(many.select(part.alias("part"), side.alias("side"), "set_key", "label"))

    def _pairs(self, rows: DataFrame, turn: int | None) -> DataFrame:
        """(a, b): pairs of set keys in a group with different labels that may be similar enough.

        rows: grp, set_key, n, label. turn 0: pairs with one class of each
        group; later ones: the nearest pair of each label in each group, by
        sketches; None: all pairs.
        """
        num, den = self.bands.num, self.bands.den

        def run(batches):
            found = _Pairs()
            for t in _whole_groups(batches, "part"):
                part, side, key, size, label = (t.column(c).to_numpy() for c in ("part", "side", "set_key", "size", "label"))
                size = size.astype(np.int64)
                sketch = Sketches(t.column("sketch"))
                passes = [sketch] if turn is not None else [sketch.coarse(FINE), sketch]
                start, end = _groups(part)
                if turn == 0:  # the smallest key with each other one
                    n = end - start - 1
                    tried = [(np.repeat(start, n), tb.ranges(start + 1, n))]
                else:  # each with those that come after all of its label
                    last = np.flatnonzero(np.concatenate(((label[1:] != label[:-1]) | (part[1:] != part[:-1]), [True])))
                    after = last[np.searchsorted(last, np.arange(len(part)))] + 1
                    tried = ((np.full(e - after[i], i), np.arange(after[i], e)) for s, e in zip(start.tolist(), end.tolist()) for i in range(s, e) if after[i] < e)
                nearest: list = []
                for a, b in _chunks(tried):
                    keep = (label[a] != label[b]) & ((side[a] == 2) | (side[a] != side[b])) & (den * np.minimum(size[a], size[b]) >= num * np.maximum(size[a], size[b]))
                    a, b = a[keep], b[keep]
                    for by in passes:
                        far = by.differ(a, b)
                        keep = far * (den + num) <= (den - num) * (size[a] + size[b])
                        a, b, far = a[keep], b[keep], far[keep]
                    if turn:
                        nearest.append(_nearest(a, b, far, np.searchsorted(start, a, side="right"), label))
                    else:
                        yield from found.add(key, a, b)
                if nearest:
                    a, b, far = (np.concatenate(x) for x in zip(*nearest))
                    a, b, _ = _nearest(a, b, far, np.searchsorted(start, a, side="right"), label)
                    yield from found.add(key, a, b)
            yield from found.rest()

        if turn != 0:  # groups that are not yet one component
            mixed = rows.groupBy("grp").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
            rows = rows.join(mixed.select("grp"), "grp", "left_semi")
        if turn is None:
            rows = cut(rows)
            sketches = self._fine(rows.select("set_key").distinct())
        else:
            sketches = self._classes.select("set_key", "size", "sketch")
        order = ["part", "set_key"] if turn == 0 else ["part", "label", "set_key"]
        dealt = self._dealt(rows, turn == 0).join(sketches, "set_key").repartition("part").sortWithinPartitions(*order)
        return dealt.select("part", "side", "set_key", "size", "sketch", "label").mapInArrow(run, "a long, b long").distinct()

    def _texts(self, needed: DataFrame) -> DataFrame:
        """(set_key, text): the text of the smallest doc_id of each set of needed; other rows of that id come too."""
        ids = self._classes.join(needed, "set_key", "left_semi").select("set_key", F.col("class_id").alias("doc_id"))
        return self.docs.join(ids, "doc_id").select("set_key", "text")

    def _fine(self, needed: DataFrame) -> DataFrame:
        """(set_key, size, sketch): finer sketches of the sets in needed."""
        n = self.n

        def run(batches):
            for batch in batches:
                want = batch.column("set_key").to_numpy()
                for block in tb.blocks(batch.column("text")):
                    h, first = shingle_sets(block, n)
                    mine = want[block.rows.start : block.rows.start + len(block)] == _set_keys(h, first)
                    h, first = _pick(h, first, np.flatnonzero(mine))
                    yield pa.RecordBatch.from_arrays([batch.column("set_key").slice(block.rows.start, len(block)).filter(pa.array(mine)), pa.array(np.diff(first)), odd_sketches(h, first, FINE)], ["set_key", "size", "sketch"])

        return cut(self._texts(needed).mapInArrow(run, "set_key long, size long, sketch binary").dropDuplicates(["set_key"]))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough. A set's text is that of its smallest doc_id."""
        n, num, den = self.n, self.bands.num, self.bands.den
        needed = pairs.select(F.col("a").alias("set_key")).union(pairs.select(F.col("b").alias("set_key"))).distinct()
        texts = self._texts(needed)
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        left = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("set_key", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
        right = salted.join(texts.withColumnRenamed("set_key", "b"), "b").select("a", "salt", "b", "text")

        def run(batches):
            mine, whose = None, None
            for batch in batches:
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                for block in tb.blocks(batch.column("text")):
                    h, first = shingle_sets(block, n)
                    keys = _set_keys(h, first).tolist()
                    x, y = [], []
                    for i in range(len(block)):
                        row, own = block.rows.start + i, h[first[i] : first[i + 1]]
                        if keys[i] != (a[row] if b[row] is None else b[row]):
                            continue  # another row with the same doc_id
                        if b[row] is None:
                            mine, whose = own, a[row]
                        elif whose == a[row]:
                            at = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
                            both = int((mine[at] == own).sum())
                            if den * both >= num * (len(mine) + len(own) - both):
                                x.append(a[row])
                                y.append(b[row])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        dealt = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return dealt.mapInArrow(run, "a long, b long")

    def solve(self):
        """(rows of sets(), classes (set_key, class_id), components (set_key, component)): each computed once."""
        if self._linked is None:
            self._sets = cut(self.sets())
            self._classes = cut(self._sets.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch"), F.max("n_shingles").alias("size")).where("class_id is not null"))
            # (sets of rows without a doc_id are in no class)
            shared = cut(self.shared())
            rows = shared.withColumn("label", F.col("set_key"))
            tried = links = None
            for turn in range(TURNS + 1):
                if turn < TURNS:
                    pairs = self._pairs(rows.where(F.pmod(F.xxhash64("grp"), F.lit(4)) == turn), turn)
                else:
                    pairs = self._pairs(rows, None)
                pairs = cut(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs)
                if pairs.isEmpty():
                    continue
                new = cut(self._verified(pairs))
                tried = pairs if tried is None else tried.union(pairs)
                if new.isEmpty():
                    continue
                links = new if links is None else links.union(new)
                label = cut(components(links))
                named = label.withColumnRenamed("node", "set_key")
                rows = shared.join(F.broadcast(named) if label.count() <= FEW else named, "set_key", "left").withColumn("label", F.coalesce("component", "set_key"))
            if links is None:
                label = shared.select(F.col("set_key").alias("node"), F.col("set_key").alias("component")).limit(0)
            self._linked = label.select(F.col("node").alias("set_key"), "component")
        return self._sets, self._classes, self._linked

    def members(self) -> DataFrame:
        """(doc_id, name, n_shingles, component_id) of every row; a row without a doc_id has no component."""
        sets, classes, label = self.solve()
        named = classes.join(label, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
        least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
        by_key = named.join(least, "component").select("set_key", "component_id")
        id_or = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
        found = sets.where("n_shingles > 0").join(by_key, "set_key", "left").select("doc_id", "name", "n_shingles", id_or)
        return found.union(sets.where("n_shingles = 0").select("doc_id", "name", "n_shingles", F.col("doc_id").alias("component_id")))

    def membership(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        return self.members().select("doc_id", "n_shingles", "component_id")


def _name():
    return F.xxhash64(F.coalesce("text", F.lit("")))


class _Pairs:
    """The pairs that a task finds, the smaller key first; those held at one time are distinct."""

    def __init__(self, most: int = 1 << 19):
        self.x, self.y, self.most = np.zeros(0, np.int64), np.zeros(0, np.int64), most

    def add(self, key, a, b):
        self.x, self.y = np.concatenate((self.x, np.minimum(key[a], key[b]))), np.concatenate((self.y, np.maximum(key[a], key[b])))
        if len(self.x) >= self.most:
            self._distinct()
            if 2 * len(self.x) >= self.most:
                yield from self.rest()

    def _distinct(self):
        order = np.lexsort((self.y, self.x))
        x, y = self.x[order], self.y[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        self.x, self.y = x[new], y[new]

    def rest(self):
        if len(self.x):
            self._distinct()
            yield pa.RecordBatch.from_arrays([pa.array(self.x), pa.array(self.y)], ["a", "b"])
            self.x = self.y = np.zeros(0, np.int64)


def _nearest(a, b, far, group, label):
    """For each label of each group the pair with the least distance that it is part of."""
    if not len(a):
        return a, b, far
    both = np.tile(np.arange(len(a)), 2)
    own, g = np.concatenate((label[a], label[b])), np.tile(group, 2)
    order = np.lexsort((both, far[both], own, g))
    first = np.concatenate(([True], (g[order][1:] != g[order][:-1]) | (own[order][1:] != own[order][:-1])))
    keep = np.unique(both[order][first])
    return a[keep], b[keep], far[keep]


def _chunks(found, most: int = 1 << 18):
    """Joins small index arrays so that each piece has about `most` pairs."""
    a, b, total = [], [], 0
    for x, y in found:
        a.append(x)
        b.append(y)
        total += len(x)
        if total >= most:
            yield np.concatenate(a), np.concatenate(b)
            a, b, total = [], [], 0
    if a:
        yield np.concatenate(a), np.concatenate(b)


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without all but the smallest doc_id of each group of near duplicates.

    Rows of that doc_id and group all stay, and so do rows without an id. Of
    rows that share a doc_id each goes or stays by its own text.
    """
    gone = JaccardJoin(docs, n, num, den).members().where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("name").alias("__name")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("__id")) & (_name() == F.col("__name")), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda p: array_to_string(list_slice(w, p, p + 3), ' ')) END) AS g FROM d),
x AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
-- of a set of n, any n - ceil(0.85 n) + 1 elements hold one that a linked set has too; the rarest are taken
f AS (SELECT t, count(*) AS c FROM x GROUP BY t),
p AS (SELECT doc_id, n, t FROM (SELECT x.*, row_number() OVER (PARTITION BY doc_id ORDER BY c, t) AS r FROM x JOIN f USING (t)) WHERE r <= n - ((85 * n + 99) // 100) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
e AS MATERIALIZED (SELECT a, b FROM (SELECT c.a, c.b, len(list_intersect(u.g, v.g)) AS i, len(u.g) + len(v.g) AS z FROM c JOIN s u ON u.doc_id = c.a JOIN s v ON v.doc_id = c.b) WHERE 100 * i >= 85 * (z - i)),
sides AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, sides.b FROM r JOIN sides ON r.b = sides.a) SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id FROM s LEFT JOIN reach ON reach.a = s.doc_id
"""
