"""Equi-depth histograms of both relations.

Boundaries come from a (sampled) value frequency table, counts from the full
one. A value is never split over two buckets. The first and last bucket reach to
the true smallest and largest value, so no row of a relation is without a bucket
when the boundaries were sampled.

The step assignment walks the distinct values in order. It only ever asks for the
place where a running total is reached, so a relation with more distinct values
than `limit` stays in the cluster: its running totals are stored there in blocks of
neighbouring values, the driver knows the end of each block, and the blocks that
the walk lands in are read one at a time. Bounds are the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import HistogramError
from ..sources.relations import sample
from ..storage import stored, written
from .buckets import bucket_of, literal_bounds

HISTOGRAM_SCHEMA = "rel string, bucket int, lo long, hi long, cnt long"


@dataclass(frozen=True)
class Histogram:
    """One relation's buckets: closed integer ranges that follow one another, and their counts."""

    lo: np.ndarray
    hi: np.ndarray
    cnt: np.ndarray

    @property
    def size(self) -> int:
        return int(self.cnt.sum())

    def __len__(self) -> int:
        return len(self.lo)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Bucket of each value, -1 outside all."""
        at = np.searchsorted(self.lo, value, "right") - 1
        inside = (at >= 0) & (value <= self.hi[np.maximum(at, 0)])
        return np.where(inside, at, -1)

    def permuted(self, order: np.ndarray) -> Histogram:
        return Histogram(self.lo[order], self.hi[order], self.cnt[order])

    def rows(self, rel: str) -> list[tuple]:
        return [(rel, i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(self.lo, self.hi, self.cnt, strict=True))]


def frame(spark: SparkSession, s: Histogram, t: Histogram) -> DataFrame:
    """Histograms of both relations as a table."""
    return spark.createDataFrame(s.rows("S") + t.rows("T"), HISTOGRAM_SCHEMA)


def from_frame(df: DataFrame) -> tuple[Histogram, Histogram]:
    """Back from the table (as many rows as buckets)."""
    rows = df.toPandas().sort_values(["rel", "bucket"])
    one = lambda r: Histogram(*[rows.loc[rows.rel == r, c].to_numpy(np.int64) for c in ("lo", "hi", "cnt")])
    return one("S"), one("T")


def frequencies(both: DataFrame) -> DataFrame:
    """rel, value, freq; partial sums before the shuffle."""
    return both.groupBy("rel", "value").agg(F.count("*").alias("freq"))


def extremes(freq: DataFrame) -> DataFrame:
    """rel, min_value, max_value."""
    return freq.groupBy("rel").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


class Totals:
    """Running totals of a relation's distinct values in order: upto(i) of the first i values, value(i) of the i-th from 0."""

    def __init__(self, value: np.ndarray, freq: np.ndarray):
        self.n, self.values = len(value), value
        self.run = np.concatenate([[0], np.cumsum(freq, dtype=np.int64)])

    def upto(self, i: int) -> int:
        return int(self.run[i])

    def value(self, i: int) -> int:
        return int(self.values[i])

    def find(self, load: float) -> int:
        """The least i with upto(i) >= load; n + 1 if there is none."""
        at = int(np.searchsorted(self.run, load, "left"))
        return at if at <= self.n else self.n + 1


class StoredTotals(Totals):
    """The same of a relation that stays in the cluster: rows (value, place, upto) in blocks of which a few are held at a time."""

    def __init__(self, rows: DataFrame, block: int, held: int = 8):
        ends = sorted((r["block"], r["n"], r["upto"]) for r in rows.groupBy("block").agg(F.count("*").alias("n"), F.max("upto").alias("upto")).collect())
        self.rows, self.block, self.held = rows, block, held
        self.n, self.ends = sum(e[1] for e in ends), np.array([e[2] for e in ends], np.int64)
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def part(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.read:
            if len(self.read) >= self.held:
                self.read.pop(next(iter(self.read)))
            got = self.rows.where(F.col("block") == b).select("place", "value", "upto").toPandas().sort_values("place")
            self.read[b] = got["value"].to_numpy(np.int64), got["upto"].to_numpy(np.int64)
        return self.read[b]

    def upto(self, i: int) -> int:
        return 0 if i == 0 else int(self.part((i - 1) // self.block)[1][(i - 1) % self.block])

    def value(self, i: int) -> int:
        return int(self.part(i // self.block)[0][i % self.block])

    def find(self, load: float) -> int:
        if load <= 0:
            return 0
        b = int(np.searchsorted(self.ends, load, "left"))
        if b == len(self.ends):
            return self.n + 1
        return b * self.block + int(np.searchsorted(self.part(b)[1], load, "left")) + 1


def step_ends(run: Totals, k: int) -> list[int]:
    """Index of the last value of each of the first k - 1 buckets.

    A bucket closes when its load reaches the target; the last takes the rest.
    The target starts at total / k and goes down by one until the last bucket
    gets a value. Targets that would leave the walk as it is are passed over.
    """
    n = run.n
    if n < k:
        raise HistogramError(f"{n} distinct values can't fill {k} buckets")
    target = run.upto(n) / k
    while True:
        ends, at, base, below = [], 0, 0, 0
        while len(ends) < k - 1 and at < n:
            end = max(run.find(base + target), at + 1)
            # the load just before the bucket closed: only a target down there changes the walk
            below = max(below, run.upto(min(end, n + 1) - 1) - base)
            if end > n:
                break
            ends.append(end - 1)
            at, base = end, run.upto(end)
        if len(ends) == k - 1 and ends[-1] < n - 1 if k > 1 else True:
            return ends
        if target <= 0:
            raise HistogramError("no target fills all buckets")
        target -= max(1, int(np.ceil(target - below)))


def optimal_ends(run: Totals, k: int) -> list[int]:
    """Ends that a local search finds least squares of the loads with: one boundary is moved as long as that lowers the sum."""
    n = run.n
    if n < k:
        raise HistogramError(f"{n} distinct values can't fill {k} buckets")
    cut = [*range(k), n]
    changed = True
    while changed:
        changed = False
        for i in range(1, k):
            # between two fixed neighbours the best cut is where the two loads are closest
            lo, hi = cut[i - 1] + 1, cut[i + 1] - 1
            middle = (run.upto(cut[i - 1]) + run.upto(cut[i + 1])) / 2
            at = min(max(run.find(middle), lo), hi)
            best = min((x for x in (at - 1, at, at + 1) if lo <= x <= hi), key=lambda x: abs(run.upto(x) - middle))
            if abs(run.upto(best) - middle) < abs(run.upto(cut[i]) - middle):
                cut[i], changed = best, True
    return [c - 1 for c in cut[1:-1]]


def distinct_ends(run: Totals, k: int) -> list[int]:
    """Every (n / k)-th distinct value, whatever its frequency, closes a bucket; with as many values as buckets each has its own."""
    n = run.n
    if n < k:
        raise HistogramError(f"{n} distinct values can't fill {k} buckets")
    return [*range(k - 1)] if n == k else [c * (n // k) for c in range(1, k)]


def step_bounds(value: np.ndarray, freq: np.ndarray, k: int) -> np.ndarray:
    return np.array(step_ends(Totals(value, freq), k), np.int64)


def optimal_bounds(value: np.ndarray, freq: np.ndarray, k: int) -> np.ndarray:
    return np.array(optimal_ends(Totals(value, freq), k), np.int64)


POLICIES = {"step": step_ends, "optimal": optimal_ends, "distinct": distinct_ends}


def running_total(freq: DataFrame, parts: int | None = None) -> DataFrame:
    """freq with `upto`, the sum of freq over smaller values of the relation, and `place`, their number, without one task seeing a whole relation."""
    spark = freq.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = freq.repartitionByRange(n, "rel", "value").withColumn("part", F.spark_partition_id())
    totals = placed.groupBy("rel", "part").agg(F.sum("freq").alias("own"), F.count("*").alias("many"))
    over = Window.partitionBy("rel").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("rel", "part", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(b) for c, b in (("own", "base"), ("many", "first"))])
    by_value = Window.partitionBy("rel", "part").orderBy("value")
    inside = by_value.rowsBetween(Window.unboundedPreceding, -1)
    # one row of totals per relation and part: of bounded size
    rows = placed.join(F.broadcast(before), ["rel", "part"])
    rows = rows.withColumn("upto", F.col("base") + F.coalesce(F.sum("freq").over(inside), F.lit(0))).withColumn("place", F.col("first") + F.row_number().over(by_value) - 1)
    return rows.drop("part", "base", "first")


def boundaries(freq: DataFrame, k: int, *, policy: str = "step", limit: int = 2_000_000, block: int = 1 << 16) -> DataFrame:
    """rel, bucket, lo, hi from a frequency table, at least two buckets.

    Up to `limit` distinct values a relation is one group of a task; beyond, it is
    walked by blocks of `block` values (StoredTotals).
    """
    if k < 2:
        raise HistogramError("at least two buckets are needed")
    ends = extremes(freq)
    rule = POLICIES[policy]

    def rows_of(rel: str, run: Totals, least: int, most: int) -> pd.DataFrame:
        last = np.array([run.value(i) for i in rule(run, k)], np.int64)
        return pd.DataFrame({"rel": rel, "bucket": np.arange(k, dtype=np.int32), "lo": np.concatenate([[least], last + 1]), "hi": np.append(last, most)})

    schema = "rel string, bucket int, lo long, hi long"
    if (freq.groupBy("rel").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > limit:
        run = stored(running_total(freq).select("rel", "value", "place", (F.col("upto") + F.col("freq")).cast("long").alias("upto"), F.floor(F.col("place") / block).cast("long").alias("block")))
        made = [rows_of(r["rel"], StoredTotals(run.where(F.col("rel") == r["rel"]), block), r["min_value"], r["max_value"]) for r in ends.collect()]
        return freq.sparkSession.createDataFrame(pd.concat(made), schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        run = Totals(pdf["value"].to_numpy(np.int64), pdf["freq"].to_numpy(np.int64))
        return rows_of(pdf["rel"].iloc[0], run, pdf["min_value"].iloc[0], pdf["max_value"].iloc[0])

    grouped = freq.select("rel", "value", "freq").join(F.broadcast(ends), "rel").groupBy("rel")
    return grouped.applyInPandas(one, schema)


def ntile_boundaries(freq: DataFrame, k: int) -> DataFrame:
    """Boundaries by cumulative share, in SQL functions only: a value goes to the bucket that its running total starts in."""
    total = freq.groupBy("rel").agg(F.sum("freq").alias("total"))
    run = running_total(freq).join(F.broadcast(total), "rel")
    own = run.withColumn("bucket", F.least(F.floor(F.col("upto") * k / F.col("total")), F.lit(k - 1)).cast("int"))
    heads = own.groupBy("rel", "bucket").agg(F.min("value").alias("lo"), F.max("value").alias("last"))
    w = Window.partitionBy("rel").orderBy("bucket")
    return heads.select("rel", (F.row_number().over(w) - 1).cast("int").alias("bucket"), "lo", (F.coalesce(F.lead("lo").over(w) - 1, F.col("last"))).alias("hi"))


def widened(bounds: DataFrame, full: DataFrame) -> DataFrame:
    """First and last bucket stretched to the smallest and largest value of the full relation."""
    w = Window.partitionBy("rel")
    rows = bounds.join(F.broadcast(extremes(full)), "rel")
    lo = F.when(F.col("bucket") == 0, F.least("lo", "min_value")).otherwise(F.col("lo"))
    hi = F.when(F.col("bucket") == F.max("bucket").over(w), F.greatest("hi", "max_value")).otherwise(F.col("hi"))
    return rows.select("rel", "bucket", lo.alias("lo"), hi.alias("hi"))


def bucket_counts(freq: DataFrame, bounds: DataFrame) -> DataFrame:
    """rel, bucket, lo, hi, cnt over the full frequencies; empty buckets count 0."""
    place = F.lit(-1)
    for r in ("S", "T"):
        place = F.when(F.col("rel") == r, bucket_of(F.col("value"), literal_bounds(bounds, r))).otherwise(place)
    hit = freq.groupBy("rel", place.alias("bucket")).agg(F.sum("freq").alias("cnt"))
    return bounds.join(hit, ["rel", "bucket"], "left").select("rel", "bucket", "lo", "hi", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def create_histograms(both: DataFrame, k: int, *, sampling: str | int = "100%", policy: str = "step", seed: int = 0, freq: DataFrame | None = None) -> DataFrame:
    """rel, bucket, lo, hi, cnt: boundaries from a sample, counts from all rows.

    freq: the full frequency table, where the caller has it; else it is made, and
    written once, since bounds and counts both read it.
    """
    full = written(frequencies(both)) if freq is None else freq
    chosen = sample(both, sampling, seed=seed)
    part = full if chosen is both else written(frequencies(chosen))
    return bucket_counts(full, written(widened(boundaries(part, k, policy=policy), full)))
