"""Candidate cells dealt to partitions, and what follows from that."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.metrics import partition_metrics
from ..operators.grid import Grid

ASSIGNMENT_SCHEMA = "partition_id int, s_bucket int, t_bucket int"
ROUTING_SCHEMA = "rel string, bucket int, partition_ids array<int>"
RECTANGLES_SCHEMA = "partition_id int, row_lo int, col_lo int, row_hi int, col_hi int"


@dataclass(frozen=True)
class Assignment:
    """part: partition of each cell (-1: none) in the grid's own order; cap: the limit it was made under; rectangles if it has any."""

    grid: Grid
    part: np.ndarray
    cap: int | None = None
    rectangles: tuple[tuple[int, int, int, int], ...] = ()

    @property
    def partitions(self) -> int:
        return int(self.part.max()) + 1 if self.part.size else 0

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Which rows and which columns each partition has (partitions x buckets)."""
        p = self.partitions
        rows, cols = np.zeros((p, self.part.shape[0]), bool), np.zeros((p, self.part.shape[1]), bool)
        i, j = np.nonzero(self.part >= 0)
        rows[self.part[i, j], i] = True
        cols[self.part[i, j], j] = True
        return rows, cols

    def costs(self) -> pd.DataFrame:
        """partition_id, input_cost, output_cost, cells, buckets, and the same for a self join."""
        rows, cols = self.sides()
        cs, ct = self.grid.s.cnt, self.grid.t.cnt
        cells = np.bincount(self.part[self.part >= 0], minlength=self.partitions)
        out = [sum(int(cs[a]) * int(ct[b]) for a, b in zip(*np.nonzero(self.part == p), strict=True)) for p in range(self.partitions)]
        # buckets of both sides by id, for a self join
        k = max(len(cs), len(ct))
        ids = np.zeros((self.partitions, k), bool)
        ids[:, self.grid.s_ids] |= rows
        ids[:, self.grid.t_ids] |= cols
        by_id = np.zeros(k, np.int64)
        by_id[self.grid.s_ids] = cs
        return pd.DataFrame(
            {
                "partition_id": np.arange(self.partitions, dtype=np.int32),
                "input_cost": rows @ cs + cols @ ct,
                "output_cost": out,
                "cells": cells,
                "buckets": rows.sum(1) + cols.sum(1),
                "self_input_cost": ids @ by_id,
                "self_buckets": ids.sum(1),
            }
        )

    def metrics(self) -> dict[str, float]:
        g = self.grid
        return partition_metrics(self.costs(), g.s.size, g.t.size, len(g.s), len(g.t))

    def frame(self, spark: SparkSession) -> DataFrame:
        i, j = np.nonzero(self.part >= 0)
        rows = [(int(self.part[a, b]), int(self.grid.s_ids[a]), int(self.grid.t_ids[b])) for a, b in zip(i, j, strict=True)]
        return spark.createDataFrame(rows, ASSIGNMENT_SCHEMA)

    def routing(self, spark: SparkSession) -> DataFrame:
        """rel, bucket, partition_ids: where rows of a bucket must go; buckets without candidate cells are missing."""
        rows, cols = self.sides()
        out = []
        for rel, sides, ids in (("S", rows, self.grid.s_ids), ("T", cols, self.grid.t_ids)):
            out += [(rel, int(ids[b]), np.flatnonzero(sides[:, b]).tolist()) for b in range(sides.shape[1]) if sides[:, b].any()]
        return spark.createDataFrame(out, ROUTING_SCHEMA)

    def rectangles_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, *r) for p, r in enumerate(self.rectangles)], RECTANGLES_SCHEMA)


def renumbered(part: np.ndarray) -> np.ndarray:
    """Partitions numbered from 0 without gaps, in the order of their numbers."""
    used = np.unique(part[part >= 0])
    out = np.full_like(part, -1)
    out[part >= 0] = np.searchsorted(used, part[part >= 0])
    return out
