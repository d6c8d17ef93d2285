"""Suffix array of a byte string by two-stage sorting, vectorised over buckets."""

from __future__ import annotations

import numpy as np

U = np.uint64


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; false for the last one."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = text[1:] != text[:-1]
    rising = text[:-1] < text[1:]
    # a run of equal bytes has the type of its last byte
    at = np.where(differs, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    known = at < n
    out[:-1][known] = rising[at[known]]
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number, zeros beyond the end."""
    out = np.concatenate((text, np.zeros(8, np.uint8))).astype(U)
    width = 1
    while width < 8:
        out = (out[:-width] << U(8 * width)) | out[width:]
        width *= 2
    return out[: len(text)]


def _sort_directly(text: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """The chosen suffixes in the order of their first `depth` bytes, equal ones by position.

    Sorted by words of 8 bytes, the most significant first; only suffixes that
    are still tied with a neighbour are looked at again.
    """
    word = _words(text)
    order = chosen[np.argsort(word[chosen], kind="stable")]
    key = word[order]
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    live = np.arange(len(order))
    at = 8
    while at < depth:
        # places whose group has more than one member
        same = group[1:] == group[:-1]
        tied = np.concatenate((same, [False])) | np.concatenate(([False], same))
        live, group = live[tied], group[tied]
        if not len(live):
            break
        suffix = order[live]
        there = suffix + at
        key = np.where(there < len(text), word[np.minimum(there, len(text) - 1)], U(0))
        if depth - at < 8:
            key &= ~((U(1) << U(8 * (8 - depth + at))) - U(1))
        by = np.argsort(key, kind="stable")
        by = by[np.argsort(group[by], kind="stable")]
        order[live] = suffix[by]
        key, g = key[by], group[by]
        group = np.concatenate(([0], np.cumsum((g[1:] != g[:-1]) | (key[1:] != key[:-1]))))
        at += 8
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All positions, ordered by the first `depth` bytes of their suffixes at least.

    Stage one sorts the suffixes smaller than their successors. Stage two scans
    the buckets of first bytes upwards: the suffix before each sorted one, if
    larger than it, is the next of its bucket. A bucket's own runs of one byte
    are induced round by round. Zeros are taken to follow the end, so two zeros
    must not stand together in the text.
    """
    n = len(text)
    small = smaller_than_next(text)
    chosen = np.flatnonzero(small)
    direct = _sort_directly(text, chosen, depth) if len(chosen) else chosen
    edge = np.searchsorted(text[direct], np.arange(257))  # direct is sorted by its first byte
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[text[n - 1]].append(np.array([n - 1]))  # the last suffix is the least of its bucket
    out = []
    for byte in range(256):
        ready = waiting[byte]
        head = np.concatenate(ready) if ready else np.zeros(0, np.int64)
        level, parts = head, [head]
        while len(level):  # larger suffixes of this bucket that follow one of it
            before = level[level > 0] - 1
            level = before[(text[before] == byte) & ~small[before]]
            parts.append(level)
        bucket = np.concatenate([*parts, direct[edge[byte] : edge[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > byte) & ~small[before]]
        if len(before):
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            cuts = np.searchsorted(text[before], np.arange(257))
            for c in np.flatnonzero(np.diff(cuts)):
                waiting[c].append(before[cuts[c] : cuts[c + 1]])
        waiting[byte] = []
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefix_at_least(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place but the first: whether it and the one before share `length` bytes."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), bool)
    live = np.flatnonzero(np.maximum(a, b) + length <= len(text))
    word = _words(text)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        live = live[word[a[live] + at] == word[b[live] + at]]
    out[live] = True
    return out
