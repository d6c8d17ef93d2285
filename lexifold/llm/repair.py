"""Re-Pair grammar compression of token ids.

Each round counts all adjacent pairs exactly and replaces the frequent ones
(non-overlapping, more frequent pairs first) by nonterminals: those above a level
that begins at 1 / STEP of the most frequent pair's count and is divided by STEP
once a round replaces less than one in fifty symbols. The last level is `least`; a
rule for fewer would take more bits than it saves. There it goes on until a round
over all pairs replaces less than one in a thousand of the symbols left. The first
round of a level counts all pairs; the next ones count those that hold a symbol
made in the round before, all of whose occurrences are at places just replaced. Documents
end in a terminal of their own and nothing that ends in it begins a rule, so no
symbol crosses documents and each can be decoded alone.

A shard as bytes: b"RPG2", the number of base symbols (uint32, little-endian),
then five arrays: the rules (two symbols each), the rules' expansion lengths,
each document's number of ids and of symbols, the symbols. An array is its
length and the bits of an element (uint32, little-endian), then the elements in
so many bits each, the last byte filled up.
"""

from __future__ import annotations

import numpy as np

from .textblocks import ranges

MAGIC = b"RPG2"
SYMBOL_BITS = 24
STEP = 64
SHORT = 32  # expansions of up to so many ids are kept when reading


def _order(seq: np.ndarray, at: np.ndarray, symbols: int):
    """(key, place) of the pairs that begin at the ascending places `at`, by key and then place; and the bits of a key's symbol.

    As a rule both fit into 64 bits, which are sorted as they are.
    """
    bits, places = max(1, (symbols - 1).bit_length()), len(seq).bit_length()
    keys = seq[at].astype(np.uint64)
    keys <<= np.uint64(bits)
    keys |= seq[at + 1]
    if 2 * bits + places > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], at[order], bits
    keys <<= np.uint64(places)
    keys |= at.astype(np.uint64)
    keys.sort()
    return keys >> np.uint64(places), (keys & np.uint64((1 << places) - 1)).astype(np.int64), bits


def _frequent(keys: np.ndarray, level: int, least: int, most: int):
    """(where in the sorted keys, how often) of up to `most` pairs that come at least `level` times, the most frequent first; the greatest count; level.

    level 0: taken from the greatest count.
    """
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    count = np.diff(np.append(at, len(keys)))
    top = int(count.max(initial=0))
    level = level or max(least, top // STEP)
    keep = np.flatnonzero(count >= level)
    keep = keep[np.argsort(-count[keep], kind="stable")[:most]]
    return at[keep], count[keep], top, level


def _replace(length: int, places, begin, count, least):
    """(rank of the pair, ascending place) of the occurrences to replace; pairs left with too few are given up.

    The pair of rank i stands at places[begin[i] : begin[i] + count[i]]; length: of the sequence.
    """
    none = np.int32(len(begin))
    places, ranks = places[ranges(begin, count)], np.repeat(np.arange(len(begin), dtype=np.int32), count)
    back = None
    if 8 * len(places) < length:  # few: places drawn together, with one between those that are not neighbours
        order = np.argsort(places)
        back, ranks = places[order], ranks[order]
        places = np.cumsum(np.minimum(np.diff(back, prepend=back[:1]), 2))
        length = int(places[-1]) + 1
    rank = np.full(length + 1, none, np.int32)  # of the pair that begins at a place; one more stands before the first and behind the last
    rank[places] = ranks
    # overlapping neighbours: the better rank stays; in runs of equal ones every second
    own, before = rank[:-1], np.concatenate((rank[-1:], rank[:-2]))
    equal = np.flatnonzero((own == before) & (own != none))
    win = own < before
    win &= own <= rank[1:]
    if len(equal):
        new = np.flatnonzero(np.diff(equal, prepend=-2) != 1)
        starts = np.repeat(equal[new] - 1, np.diff(np.append(new, len(equal))))  # where each one's run begins
        size = np.repeat(np.diff(np.append(new, len(equal))) + 1, np.diff(np.append(new, len(equal))))
        nth = equal - starts
        # an even one yields to neither equal neighbour, the last one to a better pair behind it
        win[equal] = (nth % 2 == 0) & ((nth + 1 < size) | (own[equal] < rank[equal + 1]))
    win &= own != none
    at = np.flatnonzero(win)
    rank = own[at]
    good = np.bincount(rank, minlength=len(begin)) >= least
    if not good.all():
        good = good[rank]
        at, rank = at[good], rank[good]
    return rank, at if back is None else back[np.searchsorted(places, at)]


def compress(ids: np.ndarray, sizes: np.ndarray, base: int, least: int = 3):
    """(rules, symbols, symbols per document). ids: below base; every document ends in an id of its own.

    sizes: ids per document, its end included, so none is 0. The end's symbol is `base`.
    """
    if len(ids) and int(ids.max()) >= base:
        raise ValueError(f"ids must be below {base}")
    seq = ids.astype(np.uint32)
    end = np.cumsum(sizes) - 1
    seq[end] = base
    rules: list[np.ndarray] = []
    symbols = base + 1  # the next one's number
    level = 0  # not known yet
    fresh = None  # the places of the symbols made in the last round, if that was of the same level
    while len(seq) > 1:
        inner = np.ones(len(seq) - 1, bool)  # whether a pair begins here: not at a document's last symbol
        inner[end[:-1]] = False
        whole = fresh is None
        if not whole:
            near = np.zeros(len(seq) + 1, bool)
            near[fresh] = near[fresh - 1] = True  # the place before the first one is the last, which is of no pair
            inner &= near[: len(inner)]
        keys, places, bits = _order(seq, np.flatnonzero(inner), symbols)
        begin, count, top, level = _frequent(keys, level, least, (1 << SYMBOL_BITS) - symbols)
        chosen = keys[begin]
        rank, at = _replace(len(seq), places, begin, count, level) if len(chosen) else (begin, begin)
        few = 50 * len(rank) < len(seq)
        last = whole and level == least and 1000 * len(rank) < len(seq)
        if few and level > least:
            level = max(least, min(level, top) // STEP if whole else level // STEP)
            fresh = None
        elif whole or 1000 * len(rank) >= len(seq):
            fresh = at - np.arange(len(at))  # each replacement takes a place from all behind it
        else:
            fresh = None
        if not len(rank):
            if last:
                break
            fresh = None
            continue
        used = np.flatnonzero(np.bincount(rank, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.uint32)
        number[used] = symbols + np.arange(len(used))
        symbols += len(used)
        rules.append(np.stack((chosen[used] >> np.uint64(bits), chosen[used] & np.uint64((1 << bits) - 1)), 1).astype(np.int64))
        seq[at] = number[rank]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        end = end - np.searchsorted(at, end)  # an end that was taken in now lies in the symbol before it
        seq = seq[keep]
        if last:
            break
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return pairs, seq, np.diff(np.concatenate(([-1], end)))


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    length = np.ones(base + 1 + len(rules), np.int64)
    later = rules.max(1, initial=0) - (base + 1)  # the last rule that a rule needs
    at = 0
    while at < len(rules):  # all that need none from `at` on
        to = at + int(np.argmax(np.append(later[at:] >= at, True)))
        length[base + 1 + at : base + 1 + to] = length[rules[at:to]].sum(1)
        at = to
    return length


def _packed(values: np.ndarray) -> bytes:
    values = values.astype(np.uint32)
    bits = max(1, int(values.max(initial=0)).bit_length())
    out = [np.array([len(values), bits], "<u4").tobytes()]
    for at in range(0, len(values), 1 << 16):  # a multiple of 8 elements fills whole bytes
        part = values[at : at + (1 << 16)].astype("<u4")
        flags = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        out.append(np.packbits(flags).tobytes())
    return b"".join(out)


def _unpacked(blob: bytes, at: int):
    """(values, where they end)."""
    n, bits = (int(x) for x in np.frombuffer(blob, "<u4", 2, at))
    size, out = -(-n * bits // 8), np.zeros(n, np.int64)
    raw = np.frombuffer(blob, np.uint8, size, at + 8)
    for i in range(0, n, 1 << 16):
        few = min(n - i, 1 << 16)
        flags = np.zeros((few, 32), np.uint8)
        flags[:, :bits] = np.unpackbits(raw[i * bits // 8 :][: -(-few * bits // 8)])[: few * bits].reshape(few, bits)
        out[i : i + few] = np.packbits(flags, axis=1, bitorder="little").view("<u4").ravel()
    return out, at + 8 + size


def pack(ids: np.ndarray, sizes: np.ndarray, base: int, **how) -> bytes:
    rules, symbols, used = compress(ids, sizes, base, **how)
    arrays = rules.ravel(), _lengths(rules, base)[base + 1 :], sizes, used, symbols
    return MAGIC + np.array([base], "<u4").tobytes() + b"".join(map(_packed, arrays))


class Shard:
    """A packed shard; end is the id that stands at the end of every document."""

    def __init__(self, blob: bytes, end: int):
        if blob[:4] != MAGIC:
            raise ValueError("not a packed shard")
        self.end = end
        self.base = int(np.frombuffer(blob, "<u4", 1, 4)[0])
        at, arrays = 8, []
        for _ in range(5):
            values, at = _unpacked(blob, at)
            arrays.append(values)
        rules, lengths, self.sizes, self.used, self.symbols = arrays
        self.rules = rules.reshape(-1, 2)
        self.length = np.concatenate((np.ones(self.base + 1, np.int64), lengths))
        self.first = np.concatenate(([0], np.cumsum(self.used)))
        self._short = None

    def _table(self):
        """(flat ids, start of each symbol): what every short symbol stands for; long ones have nothing."""
        if self._short is None:
            size = np.where(self.length <= SHORT, self.length, 0)
            start = np.cumsum(size) - size
            flat = np.zeros(int(size.sum()), "<u4")
            flat[: self.base + 1] = np.arange(self.base + 1)
            flat[self.base] = self.end
            for n in range(2, SHORT + 1):  # children are shorter
                rule = np.flatnonzero(self.length[self.base + 1 :] == n)
                own = start[self.base + 1 + rule]
                for child, offset in ((self.rules[rule, 0], 0), (self.rules[rule, 1], self.length[self.rules[rule, 0]])):
                    flat[ranges(own + offset, self.length[child])] = flat[ranges(start[child], self.length[child])]
            self._short = flat, start
        return self._short

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, start = self._table()
        while (long := self.length[symbols] > SHORT).any():  # each by its two parts
            size = 1 + long
            out = np.repeat(symbols, size)
            at = (np.cumsum(size) - size)[long]
            pair = self.rules[symbols[long] - self.base - 1]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return flat[ranges(start[symbols], self.length[symbols])]

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        return self._expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, from its own symbols."""
        return self._expand(self.symbols[self.first[i] : self.first[i + 1]])

    def slice(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document i: only symbols that reach into that range are expanded."""
        mine = self.symbols[self.first[i] : self.first[i + 1]]
        length = self.length[mine]
        ends = np.cumsum(length)
        start, stop = max(0, start), min(stop, int(ends[-1]))
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends - length, stop, side="left")
        skip = start - int(ends[a] - length[a])
        return self._expand(mine[a:b])[skip : skip + stop - start]
