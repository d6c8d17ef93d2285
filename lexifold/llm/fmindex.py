"""FM-index over a sequence of word ids: wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np

U = np.uint64


class BitRank:
    """A bit vector with counts of the ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (U(1) << (at & 63).astype(U)) - U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(U)) & U(1)


class WaveletTree:
    """Ranks of any symbol; the nodes of a level lie side by side in one bit vector."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        self.height = max(1, int(sigma - 1).bit_length())
        for level in range(self.height - 1, -1, -1):
            bit = (seq >> level) & 1
            self.levels.append((level, BitRank(bit), int(len(seq) - bit.sum())))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        low = np.zeros_like(at)
        for level, bits, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            up, down = bits.rank(at), bits.rank(low)
            at = np.where(one, zeros + up, at - up)
            low = np.where(one, zeros + down, low - down)
        return at - low


def suffix_array(seq: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Order of all suffixes of seq, whose zeros end the runs and sort by run."""
    n = len(seq)
    first = np.where(seq == 0, runs, seq + runs[-1] + 1)
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else second[: n - step]
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = new
        if rank.max() == n - 1:
            return order
        step *= 2


class FMIndex:
    """seq: symbols from 1 to sigma - 1, each run closed by a zero."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16):
        closing = seq == 0
        runs = np.cumsum(closing) - closing
        order = suffix_array(seq, runs)
        self.last = seq[order - 1]  # the symbol before each suffix
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        self.tree = WaveletTree(self.last, sigma)
        begin = np.concatenate(([0], np.flatnonzero(closing)[:-1] + 1))
        sampled = (order - begin[runs[order]]) % sample == 0  # a run's first symbol is, so no walk leaves its run
        self.marks = BitRank(sampled.astype(np.uint8))
        self.samples = order[sampled]
        self.size = len(seq)

    def _step(self, symbol, at):
        return self.starts[symbol] + self.tree.rank(symbol, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray):
        """[low, high) rows of each phrase by backward search. phrases: ids, one row each, -1 beyond the length."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (high > low))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            low[live], high[live] = self._step(symbol, low[live]), self._step(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence, walking back to the next sampled one."""
        out = np.empty(len(rows), np.int64)
        left, walked = np.arange(len(rows)), 0
        while len(left):
            there = self.marks[rows].astype(bool)
            out[left[there]] = self.samples[self.marks.rank(rows[there])] + walked
            left, rows = left[~there], rows[~there]
            rows = self._step(self.last[rows], rows)
            walked += 1
        return out
