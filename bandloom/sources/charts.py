"""Data of charts as tables (x, y, series); drawing is left to whatever tool is at hand."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_points(cells: DataFrame) -> DataFrame:
    """A point for each candidate cell: columns to the right, rows downwards."""
    return cells.select(F.col("t_bucket").cast("double").alias("x"), (-F.col("s_bucket")).cast("double").alias("y"), F.lit("candidate").alias("series"))


def rearranged_points(cells: DataFrame) -> DataFrame:
    """The same at new places (cells with s_pos, t_pos)."""
    return cells.select(F.col("t_pos").cast("double").alias("x"), (-F.col("s_pos")).cast("double").alias("y"), F.lit("candidate").alias("series"))


def partition_points(assignment: DataFrame) -> DataFrame:
    """Cells in a series for each partition."""
    return assignment.select(F.col("t_bucket").cast("double").alias("x"), (-F.col("s_bucket")).cast("double").alias("y"), F.concat(F.lit("partition "), F.col("partition_id").cast("string")).alias("series"))


def rectangle_outlines(rectangles: DataFrame) -> DataFrame:
    """Five corners of each rectangle, in drawing order."""
    corners = F.array(*[F.struct(F.lit(i).alias("step"), x.cast("double").alias("x"), (-y).cast("double").alias("y")) for i, (x, y) in enumerate([(F.col("col_lo"), F.col("row_lo")), (F.col("col_hi"), F.col("row_lo")), (F.col("col_hi"), F.col("row_hi")), (F.col("col_lo"), F.col("row_hi")), (F.col("col_lo"), F.col("row_lo"))])])
    rows = rectangles.select(F.concat(F.lit("rectangle "), F.col("partition_id").cast("string")).alias("series"), F.inline(corners))
    return rows.select("x", "y", "series", "step")


def metric_lines(cases: DataFrame, names: Iterable[str]) -> DataFrame:
    """A line for each measure over the caps, each divided by its largest value."""
    from ..functions.metrics import normalized_cases

    names = list(names)
    rows = normalized_cases(cases, names)
    return rows.unpivot(["cap"], names, "series", "y").select(F.col("cap").cast("double").alias("x"), "y", "series")
