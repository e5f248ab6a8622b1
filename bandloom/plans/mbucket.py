"""M-Bucket-I: rectangles that cover all candidate cells under a cap on input.

Rows are covered in blocks. For a block of given height, columns are swept from
left to right and a new rectangle begins where the next column's additional
input would pass the cap. The height that covers most candidate cells per
rectangle wins, the taller at a tie. Sets of rows are held as bits of integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ..errors import PartitioningError
from ..operators.grid import Grid
from .assignment import Assignment

Rectangle = tuple[int, int, int, int]


class Cover:
    def __init__(self, grid: Grid):
        self.grid = grid
        self.cs = [int(x) for x in grid.s.cnt]
        self.ct = [int(x) for x in grid.t.cnt]
        self.column = [sum(1 << int(i) for i in np.flatnonzero(grid.possible[:, j])) for j in range(len(self.ct))]
        self.area = np.concatenate([[0], np.cumsum(grid.possible.sum(1))])

    def _input(self, rows: int) -> int:
        total = 0
        while rows:
            low = rows & -rows
            total += self.cs[low.bit_length() - 1]
            rows ^= low
        return total

    def block(self, top: int, bottom: int, cap: int) -> list[tuple[int, int, int]]:
        """Column ranges and input costs of the rectangles over rows top to bottom."""
        mask = ((1 << (bottom - top + 1)) - 1) << top
        done, begin, cost, rows = [], 0, 0, 0
        for j, bits in enumerate(self.column):
            own = bits & mask
            if not own:
                continue
            more = self.ct[j] + self._input(own & ~rows)
            if rows and cost + more > cap:
                done.append((begin, j - 1, cost))
                begin, cost, rows = j, 0, 0
                more = self.ct[j] + self._input(own)
            cost += more
            rows |= own
        return [*done, (begin, len(self.ct) - 1, cost)]

    def best_block(self, top: int, cap: int) -> tuple[int, list[tuple[int, int, int]]] | None:
        best, score = None, -1.0
        for bottom in range(top, len(self.cs)):
            parts = self.block(top, bottom, cap)
            if any(c > cap for _, _, c in parts):
                break
            now = (self.area[bottom + 1] - self.area[top]) / len(parts)
            if now >= score:
                best, score = (bottom, parts), now
        return best

    def rectangles(self, cap: int, most: int) -> list[Rectangle] | None:
        """At most `most` rectangles (row, column, last row, last column), or None."""
        out: list[Rectangle] = []
        top = 0
        while top < len(self.cs):
            found = self.best_block(top, cap)
            if found is None or len(out) + len(found[1]) > most:
                return None
            bottom, parts = found
            out += [(top, a, bottom, b) for a, b, _ in parts]
            top = bottom + 1
        return out


def lowest(lower: int, upper: int, try_: Callable[[int], object | None]) -> tuple[int, object]:
    """The cap that bisection settles on, and what it gives; feasibility is taken to be monotone, and the last cap is feasible by test."""
    result = None
    while lower <= upper:
        mid = (lower + upper) // 2
        got = try_(mid)
        if got is None:
            lower = mid + 1
            continue
        result = mid, got
        if lower == mid:
            return result
        upper = mid
    if result is None or result[0] < lower:
        raise PartitioningError(f"no cap up to {upper} gives few enough partitions")
    return result


def _assignment(grid: Grid, rectangles: list[Rectangle], cap: int) -> Assignment:
    part = np.full(grid.possible.shape, -1, np.int64)
    for p, (r0, c0, r1, c1) in enumerate(rectangles):
        block = part[r0 : r1 + 1, c0 : c1 + 1]
        block[grid.possible[r0 : r1 + 1, c0 : c1 + 1]] = p
    return Assignment(grid, part, cap, tuple(rectangles))


def at_cap(grid: Grid, partitions: int, cap: int) -> Assignment | None:
    found = Cover(grid).rectangles(cap, partitions)
    return None if found is None else _assignment(grid, found, cap)


def find_lowest(grid: Grid, partitions: int) -> Assignment:
    """The partitioning under the smallest cap found by bisection."""
    cover = Cover(grid)
    low = int(2 * math.sqrt(grid.candidate_cells / partitions))
    cap, found = lowest(low, grid.s.size + grid.t.size, lambda c: cover.rectangles(c, partitions))
    return _assignment(grid, found, cap)
