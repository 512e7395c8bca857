"""Random permutations of 0..n-1 that are evaluated point by point, so that no task holds or sorts
all n: one for each seed and repetition, the same wherever a point is looked up.

Up to DIRECT points a permutation is drawn as it is. Beyond, a point is a cell (row, column) of a
grid of about sqrt(n) x sqrt(n), and a Feistel network adds to its row a random function of its
column, then to its column one of its row, ROUNDS times. Points that land on the few cells of the
grid from n on go through the network again until they are below n.
"""

from __future__ import annotations

import math

import numpy as np

#: Double rounds. With three, 1025 points and edges that join cells of one column of the grid, means of
#: counts were off by 4 standard errors of 20000 draws; with four by 2, as with drawn permutations.
ROUNDS = 4
#: Points of a permutation that is drawn as it is. Points that go through the network at once, so that they stay in a core's cache.
DIRECT, BLOCK = 1024, 1 << 15


def _add(to: np.ndarray, table: np.ndarray, at: np.ndarray, size: int) -> None:
    """to = (to + table[at]) % size, in place: of the sum and the sum less size, read without a sign,
    the smaller one is below size."""
    to += table.take(at, mode="clip")
    np.minimum(to.view(np.uint64), (to - size).view(np.uint64), out=to.view(np.uint64))


class Relabelling:
    """Labels 0, 1, ... dealt at random to the points 0..n-1; sizes: how many points get each."""

    def __init__(self, sizes: list[int]) -> None:
        self.upto = np.cumsum(np.asarray(sizes, np.int64))  # label k has the places from upto[k - 1] to upto[k]
        self.n = n = int(sum(sizes))
        self.rows = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.width = max(1, -(-n // self.rows))
        first = np.arange(self.rows, dtype=np.int64) * self.width
        label = np.searchsorted(self.upto, first, "right")
        self.several = len(sizes)  # stands for rows of several labels, or with places from n on
        odd = (label != np.searchsorted(self.upto, first + self.width - 1, "right")) | (first + self.width > n)
        self.of_row = np.where(odd, self.several, label).astype(np.min_scalar_type(self.several))

    def split(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What of_points() takes: row and column of each point."""
        return np.divmod(np.asarray(points, np.int64), self.width)

    def of_points(self, split: tuple[np.ndarray, np.ndarray], seed: int, rep: int) -> np.ndarray:
        """The label of each point in one repetition."""
        draw = np.random.default_rng([seed % (1 << 64), rep])
        if self.n <= DIRECT:
            return np.searchsorted(self.upto, draw.permutation(self.n)[split[0] * self.width + split[1]], "right").astype(self.of_row.dtype)
        by_col = draw.integers(0, self.rows, (ROUNDS, self.width))
        by_row = draw.integers(0, self.width, (ROUNDS, self.rows))

        def through(row: np.ndarray, col: np.ndarray) -> None:
            for k in range(ROUNDS):
                _add(row, by_col[k], col, self.rows)
                _add(col, by_row[k], row, self.width)

        found = np.empty(len(split[0]), self.of_row.dtype)
        for a in range(0, len(found), BLOCK):
            row, col = (x[a : a + BLOCK].copy() for x in split)
            through(row, col)
            label = self.of_row.take(row)
            odd = np.flatnonzero(label == self.several)  # few, as there are about sqrt(n) rows
            row, col = row[odd], col[odd]
            while len(out := np.flatnonzero(row * self.width + col >= self.n)):
                again = row[out], col[out]
                through(*again)
                row[out], col[out] = again
            label[odd] = np.searchsorted(self.upto, row * self.width + col, "right")
            found[a : a + BLOCK] = label
        return found
