"""Vantage-point trees: rows split again and again by their distance to one of them."""

from __future__ import annotations

import heapq
import math

import numpy as np


class VPTree:
    """Euclidean, over the rows of `points`, halves of equal size, at most `leaf` rows in a leaf.

    A node has its vantage point and, for each half, the least and the greatest
    distance to it. With `whole_space` the halves stand for all points of the
    space that would go there, not only for the rows.
    """

    def __init__(self, points: np.ndarray, leaf: int, whole_space: bool = False):
        self.points, self.leaf, self.whole_space = points, max(1, leaf), whole_space
        self.nodes: list = []  # rows of a leaf, or (vantage point, ((child, least, greatest), (child, least, greatest)))
        self.leaves: list[int] = []
        if len(points):
            self._grow(np.arange(len(points)))

    def _grow(self, rows) -> int:
        number = len(self.nodes)
        self.nodes.append(rows)
        if len(rows) <= self.leaf:
            self.leaves.append(number)
            return number
        vantage = self.points[rows[np.argmax(distances(self.points[rows], self.points[rows[0]]))]]  # at the rim
        d = distances(self.points[rows], vantage)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        d = d[order]
        near, far = ((0.0, d[half - 1]), (d[half - 1], math.inf)) if self.whole_space else ((d[0], d[half - 1]), (d[half], d[-1]))
        inner = self._grow(rows[order[:half]])
        outer = self._grow(rows[order[half:]])
        self.nodes[number] = vantage, ((inner, *near), (outer, *far))
        return number

    def route(self, points: np.ndarray) -> np.ndarray:
        """For each point the place in `leaves` of the leaf it goes to."""
        at = np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            number, rows = waiting.pop()
            node = self.nodes[number]
            if not isinstance(node, tuple):
                at[rows] = number
                continue
            vantage, ((inner, _, limit), (outer, _, _)) = node
            near = distances(points[rows], vantage) <= limit
            waiting += [(inner, rows[near]), (outer, rows[~near])]
        return np.searchsorted(np.array(self.leaves), at)

    def leaves_within(self, q: np.ndarray, near: float, far: float) -> list[int]:
        """Places in `leaves` of those that may hold a point at a distance between near and far."""
        return [self._place(number) for number in self.pages(q, near, lambda: far, numbers=True)]

    def _place(self, number: int) -> int:
        return int(np.searchsorted(self.leaves, number))

    def pages(self, q: np.ndarray, near: float, far, numbers: bool = False):
        """The leaves' rows, nearest first, of the annulus from near to far(), which may shrink meanwhile."""
        queue = [(0.0, 0, math.inf)] if self.nodes else []
        while queue:
            low, number, high = heapq.heappop(queue)
            if low > far():
                return
            node = self.nodes[number]
            if not isinstance(node, tuple):
                yield number if numbers else node
                continue
            vantage, halves = node
            d = float(np.sqrt(((vantage - q) ** 2).sum()))
            for child, least, greatest in halves:
                a, b = max(low, d - greatest, least - d), min(high, d + greatest)
                if b >= near and a <= far():
                    heapq.heappush(queue, (a, child, b))


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    x = points - to
    return np.sqrt(np.einsum("ij,ij->i", x, x))
