"""The grid of bucket pairs: which cells can hold results, and what they cost.

A grid has at most a few hundred buckets a side, so it is held as arrays on the
driver; frames of it (one row per candidate cell) go into joins. Rows and columns
may stand in another order than the buckets; the bucket ids go along, and nothing
is renumbered.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import JoinError, RearrangementError
from ..functions.bands import BandQuery
from .histogram import Histogram

CELLS_SCHEMA = "s_bucket int, t_bucket int, weight long"


@dataclass(frozen=True)
class Grid:
    """s, t: histograms in the order of rows and columns; possible: candidate cells; s_ids, t_ids: buckets by place."""

    s: Histogram
    t: Histogram
    possible: np.ndarray
    s_ids: np.ndarray
    t_ids: np.ndarray
    query: BandQuery | None = None

    @classmethod
    def of(cls, s: Histogram, t: Histogram, query: BandQuery | str | None = None, possible: np.ndarray | None = None) -> Grid:
        q = None if query is None else BandQuery.of(query)
        if possible is None:
            if q is None:
                raise JoinError("a grid needs a query or its cells")
            possible = q.cells(s.lo, s.hi, t.lo, t.hi)
        # a cell of two empty buckets holds nothing
        possible = possible & ((s.cnt[:, None] + t.cnt[None, :]) > 0)
        return cls(s, t, possible, np.arange(len(s)), np.arange(len(t)), q)

    @property
    def weight(self) -> np.ndarray:
        """Input of each candidate cell: counts of its two buckets; 0 elsewhere."""
        return np.where(self.possible, self.s.cnt[:, None] + self.t.cnt[None, :], 0)

    @property
    def candidate_cells(self) -> int:
        return int(self.possible.sum())

    def candidates_between(self, first: int, last: int) -> int:
        """Candidate cells in rows first to last."""
        return int(self.possible[first : last + 1].sum())

    @property
    def output_cost(self) -> int:
        """Pairs to compare: products of counts over candidate cells (as a Python integer, which can't overflow)."""
        return sum(int(self.s.cnt[i]) * int(self.t.cnt[j]) for i, j in zip(*np.nonzero(self.possible), strict=True))

    def permuted(self, rows: np.ndarray | None = None, cols: np.ndarray | None = None) -> Grid:
        """Row i of the new grid is row rows[i] of this one; likewise columns."""
        r = np.arange(len(self.s)) if rows is None else np.asarray(rows)
        c = np.arange(len(self.t)) if cols is None else np.asarray(cols)
        for order, n in ((r, len(self.s)), (c, len(self.t))):
            if not np.array_equal(np.sort(order), np.arange(n)):
                raise RearrangementError("not a permutation")
        return replace(self, s=self.s.permuted(r), t=self.t.permuted(c), possible=self.possible[np.ix_(r, c)], s_ids=self.s_ids[r], t_ids=self.t_ids[c])

    def transposed(self) -> Grid:
        return replace(self, s=self.t, t=self.s, possible=self.possible.T, s_ids=self.t_ids, t_ids=self.s_ids, query=None if self.query is None else self.query.negated())

    def frame(self, spark: SparkSession) -> DataFrame:
        """s_bucket, t_bucket, weight of the candidate cells."""
        w = self.weight
        rows = [(int(self.s_ids[i]), int(self.t_ids[j]), int(w[i, j])) for i, j in zip(*np.nonzero(self.possible), strict=True)]
        return spark.createDataFrame(rows, CELLS_SCHEMA)


def candidate_cells(histogram: DataFrame, query: BandQuery | str) -> DataFrame:
    """The candidate cells of a histogram table in SQL functions: s_bucket, t_bucket, weight.

    Both sides have one row per bucket, a number that the caller chose.
    """
    q = BandQuery.of(query)
    s = histogram.where("rel = 'S'").select(F.col("bucket").alias("s_bucket"), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), F.col("cnt").alias("s_cnt"))
    t = histogram.where("rel = 'T'").select(F.col("bucket").alias("t_bucket"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"), F.col("cnt").alias("t_cnt"))
    fits = F.lit(False)
    for b in q.bands:
        one = F.lit(True)
        if b.lo is not None:
            one = one & (F.col("t_lo") + b.lo <= F.col("s_hi"))
        if b.hi is not None:
            one = one & (F.col("s_lo") <= F.col("t_hi") + b.hi)
        fits = fits | one
    return s.join(F.broadcast(t), fits & (F.col("s_cnt") + F.col("t_cnt") > 0)).select("s_bucket", "t_bucket", (F.col("s_cnt") + F.col("t_cnt")).alias("weight"))


def exact_cells(freq: DataFrame, histogram: DataFrame, query: BandQuery | str) -> DataFrame:
    """Cells that do hold a result, by the values themselves: s_bucket, t_bucket (what candidate_cells must contain)."""
    from .bandjoin import band_join_values
    from .buckets import bucket_of, literal_bounds

    s, t = (freq.where(F.col("rel") == r).select("value", "freq") for r in ("S", "T"))
    found = band_join_values(s, t, query, counted=True).select("s", "t")
    sb, tb = (literal_bounds(histogram, r) for r in ("S", "T"))
    return found.select(bucket_of(F.col("s"), sb).alias("s_bucket"), bucket_of(F.col("t"), tb).alias("t_bucket")).distinct()


def dense(cells: DataFrame, k_s: int, k_t: int) -> DataFrame:
    """s_bucket and line (comma-separated weights of all t buckets): the grid as dense text, one line per row."""
    spark = cells.sparkSession
    rows = spark.range(k_s).select(F.col("id").cast("int").alias("s_bucket"))
    grouped = cells.groupBy("s_bucket").agg(F.map_from_entries(F.collect_list(F.struct("t_bucket", "weight"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(k_t - 1))
    value = lambda j: F.coalesce(F.element_at("m", j), F.lit(0)).cast("string")
    line = F.when(F.col("m").isNull(), F.array_join(F.transform(every, lambda j: F.lit("0")), ",")).otherwise(F.array_join(F.transform(every, value), ","))
    return rows.join(grouped, "s_bucket", "left").select("s_bucket", line.alias("line"))


def sparse(lines: DataFrame) -> DataFrame:
    """Candidate cells back from dense lines (s_bucket, line)."""
    cell = F.posexplode(F.split("line", ",")).alias("t_bucket", "weight")
    return lines.select("s_bucket", cell).select("s_bucket", "t_bucket", F.trim("weight").cast("long").alias("weight")).where("weight <> 0")


def normalized(cells: DataFrame, top: int = 999) -> DataFrame:
    """Weights scaled so that the largest is `top` (truncated)."""
    high = F.max("weight").over(Window.partitionBy(F.lit(1)))
    return cells.withColumn("weight", F.floor(F.col("weight") * top / high).cast("long"))


def permuted_cells(cells: DataFrame, order: DataFrame) -> DataFrame:
    """s_pos, t_pos beside the bucket ids, for an order table (axis, pos, bucket); an axis that is missing keeps its order."""
    for axis, bucket, pos in (("rows", "s_bucket", "s_pos"), ("columns", "t_bucket", "t_pos")):
        own = order.where(F.col("axis") == axis).select(F.col("bucket").alias(bucket), F.col("pos").alias(pos))
        cells = cells.join(F.broadcast(own), bucket, "left").withColumn(pos, F.coalesce(pos, bucket))
    return cells
