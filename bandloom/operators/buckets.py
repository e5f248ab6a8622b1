"""Bucket of a value among closed ranges that follow one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bounds = tuple[tuple[int, int], ...]


def bucket_of(value: Column, bounds: Bounds) -> Column:
    """Bucket of a value; -1 outside all.

    A balanced tree of comparisons: a row takes as many steps as the logarithm of
    the buckets, in generated code for any number that a plan may have.
    """
    if not bounds:
        return F.lit(-1)

    def below(a: int, b: int) -> Column:
        if b - a == 1:
            return F.lit(a)
        middle = (a + b) // 2
        return F.when(value <= bounds[middle - 1][1], below(a, middle)).otherwise(below(middle, b))

    inside = (value >= bounds[0][0]) & (value <= bounds[-1][1])
    return F.when(inside, below(0, len(bounds))).otherwise(F.lit(-1))


def literal_bounds(histogram: DataFrame, rel: str) -> Bounds:
    """(lo, hi) of a relation's buckets in order; as many as the caller asked for."""
    rows = histogram.where(F.col("rel") == rel).select("bucket", "lo", "hi").collect()
    return tuple((r["lo"], r["hi"]) for r in sorted(rows, key=lambda r: r["bucket"]))
