"""Agglomerative partitioning: candidate cells are merged pair by pair.

All pairwise distances are matrices; a merge changes one row and one column of
them. Of equal distances the pair with the smallest numbers is merged.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from ..errors import PartitioningError
from ..operators.grid import Grid
from .assignment import Assignment, renumbered
from .mbucket import lowest

MAX_INPUT, MAX_CELLS = "MAX_PARTITION_INPUT", "MAX_PARTITION_CANDIDATE_CELLS"
INF = np.inf


class State:
    """Groups of cells: their rows, columns, input costs, cells, and pairwise shared costs and distances."""

    def __init__(self, grid: Grid):
        self.grid = grid
        self.cells = np.argwhere(grid.possible)
        n = len(self.cells)
        i, j = self.cells.T if n else (np.zeros(0, int), np.zeros(0, int))
        self.rows, self.cols = np.zeros((n, len(grid.s)), bool), np.zeros((n, len(grid.t)), bool)
        self.rows[np.arange(n), i] = True
        self.cols[np.arange(n), j] = True
        self.cs, self.ct = grid.s.cnt.astype(np.float64), grid.t.cnt.astype(np.float64)
        self.row_in, self.col_in = self.rows @ self.cs, self.cols @ self.ct
        self.size = np.ones(n)
        self.owner = np.arange(n)
        self.alive = np.ones(n, bool)
        self.shared_rows = (self.rows * self.cs) @ self.rows.T
        self.shared_cols = (self.cols * self.ct) @ self.cols.T
        # sums of Manhattan distances between the cells of two groups
        self.apart = np.abs(i[:, None] - i[None, :]).astype(np.float64) + np.abs(j[:, None] - j[None, :])

    @property
    def cost(self) -> np.ndarray:
        return self.row_in + self.col_in

    def union_rows(self, a, b=slice(None)) -> np.ndarray:
        return self.row_in[a][..., None] + self.row_in[b] - self.shared_rows[a][..., b] if np.ndim(a) else self.row_in[a] + self.row_in[b] - self.shared_rows[a, b]

    def union_cols(self, a, b=slice(None)) -> np.ndarray:
        return self.col_in[a][..., None] + self.col_in[b] - self.shared_cols[a][..., b] if np.ndim(a) else self.col_in[a] + self.col_in[b] - self.shared_cols[a, b]

    def union_cost(self, a) -> np.ndarray:
        """Input cost of group a (or of all) joined with each group."""
        return self.union_rows(a) + self.union_cols(a)

    def merge(self, a: int, b: int) -> None:
        """Group b goes into group a."""
        self.rows[a] |= self.rows[b]
        self.cols[a] |= self.cols[b]
        self.row_in[a], self.col_in[a] = self.rows[a] @ self.cs, self.cols[a] @ self.ct
        self.size[a] += self.size[b]
        self.owner[self.owner == b] = a
        self.alive[b] = False
        for m, mine, unit in ((self.shared_rows, self.rows, self.cs), (self.shared_cols, self.cols, self.ct)):
            m[a] = m[:, a] = mine @ (mine[a] * unit)
        self.apart[a] += self.apart[b]
        self.apart[:, a] += self.apart[:, b]

    def assignment(self, cap: int | None) -> Assignment:
        part = np.full(self.grid.possible.shape, -1, np.int64)
        if len(self.cells):
            part[tuple(self.cells.T)] = self.owner
        return Assignment(self.grid, renumbered(part), cap)


Distance = Callable[[State, int, float, float], np.ndarray]


def _all(s: State) -> np.ndarray:
    return np.arange(len(s.cost))


def _added_to_larger(s: State, a: int, cap_in: float, cap_cells: float) -> np.ndarray:
    return s.union_cost(a) - np.maximum(s.cost[a], s.cost)


def _share_of_sum(s: State, a: int, cap_in: float, cap_cells: float) -> np.ndarray:
    return s.union_cost(a) / np.maximum(s.cost[a] + s.cost, 1e-300)


def _fewer_cells(s: State, a: int, cap_in: float, cap_cells: float) -> np.ndarray:
    return np.minimum(s.size[a], s.size)


def _smaller_within_input(s: State, a: int, cap_in: float, cap_cells: float) -> np.ndarray:
    return np.where(s.union_cost(a) <= cap_in, np.minimum(s.cost[a], s.cost), INF)


def _smaller_within_cells(s: State, a: int, cap_in: float, cap_cells: float) -> np.ndarray:
    return np.where(s.size[a] + s.size <= cap_cells, np.minimum(s.size[a], s.size), INF)


def _bucket_jaccard(s: State, a: int, cap_in: float, cap_cells: float) -> np.ndarray:
    both = (s.rows & s.rows[a]).sum(1) + (s.cols & s.cols[a]).sum(1)
    n = s.rows.sum(1) + s.cols.sum(1)
    return 1 - both / np.maximum(n + n[a] - both, 1)


def _mean_manhattan(s: State, a: int, cap_in: float, cap_cells: float) -> np.ndarray:
    return s.apart[a] / (s.size[a] * s.size)


def weighted(row_weight: float, col_weight: float) -> Distance:
    """The share of the sum with rows and columns weighted."""

    def measure(s: State, a: int, cap_in: float, cap_cells: float) -> np.ndarray:
        own = row_weight * s.row_in + col_weight * s.col_in
        return (row_weight * s.union_rows(a) + col_weight * s.union_cols(a)) / np.maximum(own[a] + own, 1e-300)

    return measure


#: Policy codes and their measures.
MEASURES: dict[str, Distance] = {
    "AICPM": _added_to_larger,
    "AICPS": _share_of_sum,
    "ACCPM": _fewer_cells,
    "EPIC": _smaller_within_input,
    "EPCC": _smaller_within_cells,
    "JB": _bucket_jaccard,
    "M": _mean_manhattan,
}


def measure_of(policy: str) -> Distance:
    if m := re.fullmatch(r"WICRC_([\d.]+)_([\d.]+)", policy):
        return weighted(float(m[1]), float(m[2]))
    if policy not in MEASURES:
        raise PartitioningError(f"unknown merge policy {policy!r}")
    return MEASURES[policy]


def merged(grid: Grid, partitions: int, policy: str, cap: int, limit: str = MAX_INPUT) -> Assignment | None:
    """Merge the closest pair that the cap allows until few enough groups are left; None if no pair is allowed before."""
    s, measure = State(grid), measure_of(policy)
    cap_in, cap_cells = (cap, INF) if limit == MAX_INPUT else (INF, cap)
    n = len(s.cells)
    if n and (s.cost.max() > cap_in or cap_cells < 1):
        return None
    if n <= partitions:
        return s.assignment(cap)
    far = np.full((n, n), INF)

    def renew(a: int) -> None:
        d = measure(s, a, cap_in, cap_cells).astype(np.float64)
        allowed = s.alive & (s.union_cost(a) <= cap_in) & (s.size[a] + s.size <= cap_cells)
        d = np.where(allowed, d, INF)
        far[a, a + 1 :] = d[a + 1 :]
        far[:a, a] = d[:a]

    for a in range(n):
        renew(a)
    for _ in range(n - partitions):
        a, b = divmod(int(far.argmin()), n)
        if far[a, b] == INF:
            return None
        s.merge(a, b)
        far[b], far[:, b] = INF, INF
        renew(a)
    return s.assignment(cap)


def find_lowest(grid: Grid, partitions: int, policy: str, limit: str = MAX_INPUT) -> Assignment:
    """The partitioning under the smallest cap found by bisection."""
    n = grid.candidate_cells
    low, high = (1, grid.s.size + grid.t.size) if limit == MAX_INPUT else (n // partitions, n)
    return lowest(low, high, lambda cap: merged(grid, partitions, policy, cap, limit))[1]


def balanced(grid: Grid, partitions: int) -> Assignment:
    """Without a cap: always the merge after which the largest input over the mean is least."""
    s = State(grid)
    n = len(s.cells)
    for left in range(n, partitions, -1):
        on = np.flatnonzero(s.alive)
        cost = s.cost[on]
        joined = s.union_cost(on)[:, on]
        total = cost.sum() - cost[:, None] - cost[None, :] + joined
        # the largest input among the others: one of the three largest
        top = np.argsort(-cost, kind="stable")[:3]
        a, b = np.arange(len(on))[:, None], np.arange(len(on))[None, :]
        rest = np.zeros_like(joined)
        for t in reversed(top):
            rest = np.where((a != t) & (b != t), np.maximum(rest, cost[t]), rest)
        score = np.maximum(rest, joined) / np.maximum(total / (left - 1), 1e-300)
        score[np.tril_indices(len(on))] = INF
        i, j = divmod(int(score.argmin()), len(on))
        s.merge(int(on[i]), int(on[j]))
    return s.assignment(None)
