"""Range search: partitionings under several caps, judged by weighted measures."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import PartitioningError
from ..functions.metrics import KINDS, scored
from ..operators.grid import Grid
from . import mbucket, merge
from .assignment import Assignment

RECTANGLE_POLICIES = ("MBI", "MBIREP")


def make(grid: Grid, partitions: int, policy: str = "MBI", cap: int | None = None, limit: str = merge.MAX_INPUT) -> Assignment | None:
    """A partitioning by policy: under the given cap (None if impossible), or under the smallest cap."""
    if policy in RECTANGLE_POLICIES:
        return mbucket.find_lowest(grid, partitions) if cap is None else mbucket.at_cap(grid, partitions, cap)
    if policy == "targetf":
        return merge.balanced(grid, partitions)
    return merge.find_lowest(grid, partitions, policy, limit) if cap is None else merge.merged(grid, partitions, policy, cap, limit)


def caps(lower: int, upper: int, granularity: int) -> list[int]:
    """Caps from upper down in steps of (upper - lower) / granularity, granularity - 1 of them, and lower; each once."""
    step = (upper - lower) // granularity
    return list(dict.fromkeys([*(upper - i * step for i in range(granularity - 1)), lower]))


def metric_names() -> list[str]:
    out = []
    for p in ("BJ", "SJ"):
        out += [f"{p}{k}{f}" for f in ("IC", "CC", "B", "BdivCC") for k in KINDS] + [f"{p}repIC", f"{p}repB"]
    return out


def cases(spark: SparkSession, grid: Grid, partitions: int, policy: str = "MBI", *, upper_factor: float = 2.0, granularity: int = 11, limit: str = merge.MAX_INPUT) -> DataFrame:
    """cap, partitions and all measures for each cap that can be kept, tried in parallel."""
    best = make(grid, partitions, policy, limit=limit)
    lower = best.cap if best.cap is not None else int(best.costs()["input_cost"].max())
    tried = caps(lower, int(lower * upper_factor), granularity)
    shared = spark.sparkContext.broadcast(grid)  # buckets x buckets, a number that the caller chose
    names = metric_names()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(key[0])
        got = make(shared.value, partitions, policy, cap, limit)
        if got is None:
            return pd.DataFrame({c: [] for c in ["cap", "partitions", *names]})
        m = got.metrics()
        return pd.DataFrame([{"cap": cap, "partitions": got.partitions} | {n: m[n] for n in names}])

    schema = "cap long, partitions int, " + ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame([(c,) for c in tried], "cap long").repartition(len(tried), "cap").groupBy("cap").applyInPandas(one, schema)


def parse_weights(text: str) -> list[dict[str, float]]:
    """Weight sets from "metric_w-metric_w|metric_w": sets parted by bars, entries by hyphens."""
    out = []
    for part in text.split("|"):
        pairs = [x.rpartition("_") for x in part.split("-") if x]
        out.append({n: float(w) for n, _, w in pairs})
    return out


def normalized_weights(sets: list[Mapping[str, float]]) -> list[dict[str, float]]:
    """Each set scaled to a sum of one."""
    return [{k: v / sum(s.values()) for k, v in s.items()} for s in sets]


def range_search(spark: SparkSession, grid: Grid, partitions: int, policy: str, weights: Mapping[str, float], **options) -> tuple[DataFrame, Assignment]:
    """Scored cases, best first, and the best partitioning."""
    ranked = scored(cases(spark, grid, partitions, policy, **options), weights)
    first = ranked.select("cap").first()
    if first is None:
        raise PartitioningError("no cap can be kept")
    return ranked, make(grid, partitions, policy, int(first["cap"]), options.get("limit", merge.MAX_INPUT))


def coverage(a: Assignment, limit: str = merge.MAX_INPUT) -> dict[str, int]:
    """What must be 0: candidate cells without a partition, other cells with one, partitions over the cap (of what limit names)."""
    inside = a.part >= 0
    capped = "cells" if limit == merge.MAX_CELLS else "input_cost"
    over = 0 if a.cap is None else int((np.array(a.costs()[capped]) > a.cap).sum())
    return {"missing": int((a.grid.possible & ~inside).sum()), "foreign": int((~a.grid.possible & inside).sum()), "over_cap": over}
