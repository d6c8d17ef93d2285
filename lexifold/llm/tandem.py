"""Tandem repeats by the method of Gusfield and Stoye, over many strings at once.

The strings are arrays of numbers laid end to end; no symbol stands in two of
them, so nothing that is found crosses a border. Every step below is one array
operation over all strings together:

1. Names (Karp, Miller, Rosenberg): level j names the substrings of 2**j
   symbols, equal names for equal substrings. The last level orders all
   suffixes: it is the suffix tree's leaf order, and levels give the longest
   common extension of two positions, forwards and backwards.
2. Blocks of the Lempel-Ziv factorisation from the longest previous factors,
   and around every block border the squares whose centre lies in the block or
   that begin in it: the leftmost occurrence of each square type is in one of
   the maximal repetitions found here.
3. The vocabulary: from each of them the suffix links (from the leaf of
   position i to that of i + 1) lead through its square types; a type is known
   by its locus, the interval of leaves below it.
4. All leaves of a locus are occurrences; occurrences of one period that stand
   side by side merge into a run.
"""

from __future__ import annotations

import numpy as np


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b), both below 2**31, equal for equal pairs."""
    key = (a.astype(np.int64) << 32) | b.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    return rank


class Strings:
    """Strings of symbols laid end to end: `symbols` (any integers), `of` (the string of each, ascending)."""

    def __init__(self, symbols: np.ndarray, of: np.ndarray):
        self.n = n = len(symbols)
        _, dense = np.unique(symbols, return_inverse=True)
        self.of = of
        self.edge = np.searchsorted(of, of, side="right")  # the end of each position's string
        level = _pairs(of - (of[0] if n else 0), dense)
        self.levels = [level]
        width = 1
        while width < n and level.max() + 1 < n:
            # what reaches beyond the end is told by its place: no two such are equal
            after = np.concatenate((level[width:] + 1, np.zeros(min(width, n), np.int64)))
            level = _pairs(level, after)
            self.levels.append(level)
            width *= 2
        self.rank = level
        self.order = np.empty(n, np.int64)
        self.order[level] = np.arange(n)
        self.common = self.forward(self.order[:-1], self.order[1:])  # of neighbouring leaves
        self._shallow = _minima(self.common)

    def forward(self, a, b):
        """The length of the longest common prefix of the suffixes at a and b (a != b; n is allowed)."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[j], 1 << j
            at = np.flatnonzero((a < self.n) & (b < self.n))
            at = at[names[a[at]] == names[b[at]]]
            out[at] += width
            a[at] += width
            b[at] += width
        return out

    def backward(self, a, b):
        """The length of the longest common suffix of what ends with positions a and b (-1 is allowed)."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[j], 1 << j
            at = np.flatnonzero((a >= width - 1) & (b >= width - 1))
            at = at[names[a[at] - width + 1] == names[b[at] - width + 1]]
            out[at] += width
            a[at] -= width
            b[at] -= width
        return out

    def previous_factors(self) -> np.ndarray:
        """For each position the length of the longest factor that also begins before it."""
        n = self.n
        out = np.zeros(n, np.int64)
        for order in (self.order, self.order[::-1]):
            smaller = _smaller_before(order)
            has = np.flatnonzero(smaller >= 0)
            here, there = order[has], order[smaller[has]]
            out[here] = np.maximum(out[here], self.forward(here, there))
        return out

    def blocks(self):
        """Starts of the Lempel-Ziv blocks, in order."""
        step = np.maximum(1, self.previous_factors()).tolist()
        starts, at = [], 0
        while at < self.n:
            starts.append(at)
            at += step[at]
        return np.array(starts, np.int64)

    def leftmost(self):
        """(start, end, period) of maximal repetitions that hold every square type's leftmost occurrence, periods primitive."""
        h = self.blocks()
        h1 = np.append(h[1:], self.n)
        h2 = np.append(h1[1:], self.n)
        same = np.append(self.of[h[1:]] == self.of[h[:-1]], False)  # the next block is of the same string
        size, both = h1 - h, np.where(same, h2, h1) - h
        found = []
        # the centre lies in the block: a copy of the period ends at the next block's start
        k = _up_to(np.where(same, size, 0))
        right = np.repeat(h1, np.where(same, size, 0))
        left = right - k
        f, b = self.forward(right, left), self.backward(right - 1, left - 1)
        good = (f > 0) & (f + b >= k)
        found.append((left - b, right + f, k, good))
        # it begins in the block, its second half reaches from there
        k = _up_to(both)
        left = np.repeat(h, both)
        right = left + k
        inside = right < np.repeat(self.edge[h], both) if len(h) else right < 0
        k, left, right = k[inside], left[inside], right[inside]
        f, b = self.forward(left, right), self.backward(left - 1, right - 1)
        good = (f > 0) & (f + b >= k)
        found.append((left - b, right + f, k, good))
        start, end, period = (np.concatenate([x[i][x[3]] for x in found]) for i in range(3))
        # with a period that is a power, its root was found at the same border, with the same ends
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
        return start[first], end[first], period[first]

    def locus(self, at, length):
        """(first, last) leaf of those whose suffixes share `length` symbols with the one at `at`."""
        leaf = self.rank[at]
        first, last = leaf.copy(), leaf.copy()
        for j in range(len(self._shallow) - 1, -1, -1):
            low, width = self._shallow[j], 1 << j
            go = np.flatnonzero(first >= width)
            go = go[low[first[go] - width] >= length[go]]
            first[go] -= width
            go = np.flatnonzero(last + width < self.n)
            go = go[low[last[go]] >= length[go]]
            last[go] += width
        return first, last

    def runs(self):
        """(start, end, period) of all runs: maximal, at least two periods long, the period their smallest."""
        start, end, period = self.leftmost()
        # through the types of a repetition by suffix links; after a period they come again
        types = np.minimum(end - start - 2 * period + 1, period)
        at = np.repeat(start, types) + _up_to(types) - 1
        k = np.repeat(period, types)
        first, last = self.locus(at, 2 * k)
        order = np.lexsort((first, k))
        first, last, k = first[order], last[order], k[order]
        new = np.append(True, (first[1:] != first[:-1]) | (k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
        first, last, k = first[new], last[new], k[new]
        size = last - first + 1
        where = self.order[np.repeat(first, size) + _up_to(size) - 1]
        k = np.repeat(k, size)
        order = np.lexsort((where, k))
        where, k = where[order], k[order]
        begins = np.append(True, (k[1:] != k[:-1]) | (where[1:] != where[:-1] + 1)) if len(k) else np.zeros(0, bool)
        begin = np.flatnonzero(begins)
        final = np.append(begin[1:], len(k)) - 1
        start, end, period = where[begin], where[final[: len(begin)]] + 2 * k[begin], k[begin]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def _up_to(counts: np.ndarray) -> np.ndarray:
    """1 .. counts[0], 1 .. counts[1] and so on, as one array."""
    begin = np.cumsum(counts) - counts
    return np.arange(1, int(counts.sum()) + 1, dtype=np.int64) - np.repeat(begin, counts)


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """[j][i]: the least of values[i : i + 2**j]."""
    out = [values]
    width = 1
    while 2 * width <= len(values):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        width *= 2
    return out if len(values) else []


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value; -1 where there is none."""
    low = _minima(values)
    at = np.arange(len(values))  # nothing in [at, i) is smaller
    for j in range(len(low) - 1, -1, -1):
        width = 1 << j
        go = np.flatnonzero(at >= width)
        go = go[low[j][at[go] - width] > values[go]]
        at[go] -= width
    return at - 1


def candidates(symbols: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int):
    """(start, end) of stretches outside of which no run of these lengths can lie, each inside one string.

    In such a run every `gram` symbols that begin before its last period come
    again in the same string, a period later; a stretch of them is at least
    (min_exponent - 1) / min_exponent of the run. Hashes of grams decide: equal
    ones by chance only lengthen the stretches. One symbol more on either side
    shows where a run ends.
    """
    gram = max(1, min(4, min_length // 2, min_length - 1, min_exponent - 1))
    n = len(symbols)
    string = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edge = first[1:][string]
    key = symbols * np.uint64(0x9E3779B97F4A7C15) + string.astype(np.uint64)
    for _ in range(gram - 1):
        key = key * np.uint64(0xD6E8FEB86659FD93)
        key[:-1] += symbols[1:]
        symbols = np.append(symbols[1:], symbols[-1:])
        key ^= key >> np.uint64(31)
    whole = np.flatnonzero(np.arange(n) + gram <= edge)
    order = whole[np.argsort(key[whole], kind="stable")]
    again = np.zeros(n + 1, bool)
    again[order[:-1][(key[order[1:]] == key[order[:-1]]) & (string[order[1:]] == string[order[:-1]])]] = True
    turn = np.flatnonzero(again[1:] != again[:-1]) + 1
    turn = np.concatenate(([0], turn)) if again[0] else turn
    start, end = turn[0::2], turn[1::2]
    cuts = np.flatnonzero(string[start] != string[np.minimum(end, n) - 1]) if len(start) else []
    if len(cuts):  # a stretch over a border: flags at a string's end may touch the next string's
        inner = np.unique(np.concatenate((start, first[1:-1][again[first[1:-1]]])))
        stops = np.append(inner[1:], n)
        ends = end[np.searchsorted(end, inner, side="right")]
        start, end = inner, np.minimum(stops, ends)
    end = np.minimum(end + (end - start + gram - 1) // (min_exponent - 1) + gram + 1, edge[start])
    start = np.maximum(start - 1, first[string[start]])
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.append(True, (start[1:] > reach[:-1]) | (string[start[1:]] != string[start[:-1]]))
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:], len(start)) - 1]


GROUP = 1 << 18  # symbols taken together


def runs(symbols: np.ndarray, first: np.ndarray, min_length: int = 2, min_exponent: int = 2):
    """(string, start, length, period) of all runs of length >= max(min_length, min_exponent * period).

    symbols: uint64, equal for equal symbols of a string; string i is
    symbols[first[i]:first[i + 1]]; starts count from the string's first symbol.
    Ordered by string, start, period.
    """
    start, end = candidates(symbols, first, min_length, min_exponent)
    found = []
    at = 0
    size = np.cumsum(end - start)
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + GROUP, side="right")))
        length = (end - start)[at:to]
        place = np.repeat(start[at:to], length) + _up_to(length) - 1
        s, e, p = Strings(symbols[place], np.repeat(np.arange(at, to), length)).runs()
        found.append((place[s], e - s, p))
        at = to
    s, n, p = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
    keep = n >= np.maximum(min_length, min_exponent * p)
    s, n, p = s[keep], n[keep], p[keep]
    string = np.searchsorted(first, s, side="right") - 1
    return string, s - first[string], n, p
