"""From relations to a join under a plan, stage by stage.

    plan = Plan.of(both, "[-1|1]", buckets=100)       # histograms, grid
    plan = plan.rearranged("BEA").partitioned(20)     # optional, optional
    pairs = plan.join()

A plan is a value: each step gives a new one. Timings of the stages go along.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import JoinError
from ..functions.bands import BandQuery
from ..operators import bandjoin, routing
from ..operators.grid import Grid
from ..operators.histogram import Histogram, create_histograms, frame, frequencies, from_frame
from ..sources.artefacts import Timings
from ..storage import written
from . import search, seriation
from .assignment import Assignment
from .merge import MAX_INPUT


@dataclass(frozen=True)
class Plan:
    both: DataFrame
    grid: Grid
    freq: DataFrame
    assignment: Assignment | None = None
    timings: Timings = field(default_factory=Timings)

    @classmethod
    def of(cls, both: DataFrame, query: BandQuery | str, *, buckets: int = 100, sampling: str | int = "100%", seed: int = 0) -> Plan:
        """both: (rel, value) of S and T."""
        times = Timings()
        with times("histograms"):
            freq = written(frequencies(both))
            s, t = from_frame(create_histograms(both, buckets, sampling=sampling, seed=seed, freq=freq))
        with times("partitionMatrixCreation"):
            grid = Grid.of(s, t, query)
        return cls(both, grid, freq, timings=times)

    @property
    def query(self) -> BandQuery:
        if self.grid.query is None:
            raise JoinError("the grid was made without a query")
        return self.grid.query

    @property
    def histogram(self) -> DataFrame:
        """The histograms in the order of buckets, whatever the order of the grid."""
        g = self.grid
        plain = lambda h, ids: Histogram(*[x[ids.argsort()] for x in (h.lo, h.hi, h.cnt)])
        return frame(self.both.sparkSession, plain(g.s, g.s_ids), plain(g.t, g.t_ids))

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        """Compressed S and T, from the table written at the start."""
        one = lambda r: self.freq.where(F.col("rel") == r).select("value", "freq")
        return one("S"), one("T")

    def rearranged(self, policy: str, **options) -> Plan:
        with self.timings("rearrangements"):
            return replace(self, grid=seriation.rearranged(self.grid, policy, **options), assignment=None)

    def partitioned(self, partitions: int, policy: str = "MBI", *, cap: int | None = None, limit: str = MAX_INPUT) -> Plan:
        with self.timings("binarySearch"):
            got = search.make(self.grid, partitions, policy, cap, limit)
        if got is None:
            raise JoinError(f"the cap {cap} can't be kept with {partitions} partitions")
        return replace(self, assignment=got)

    def searched(self, partitions: int, policy: str, weights: dict[str, float], **options) -> Plan:
        with self.timings("rangeSearch"):
            _, best = search.range_search(self.both.sparkSession, self.grid, partitions, policy, weights, **options)
        return replace(self, assignment=best)

    def join(self, *, mode: str = "or") -> DataFrame:
        """s, t, mult (and band_id): by the assignment if there is one, else by the strategy that bandjoin chooses."""
        s, t = self._sides()
        if self.assignment is None:
            return bandjoin.band_join_values(s, t, self.query, mode=mode, counted=True)
        spark = self.both.sparkSession
        pairs = routing.partitioned_join(s, t, self.query, self.histogram, self.assignment.frame(spark), mode=mode, counted=True)
        return pairs.drop("partition_id")

    def counters(self) -> DataFrame:
        if self.assignment is None:
            raise JoinError("counters need an assignment")
        return routing.counters(*self._sides(), self.query, self.histogram, self.assignment.frame(self.both.sparkSession), counted=True)
