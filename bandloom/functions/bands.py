"""Bands on the difference S - T and disjunctions of them.

A band is the closed range lo <= s - t <= hi; None leaves an end open. The text
form is ``[lo|hi]_[lo|hi]``, with an empty side for an open end.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import JoinError
from .java_random import JavaRandom

BANDS_SCHEMA = "band_id int, lo long, hi long"
_TEXT = re.compile(r"\[(-?\d*)\|(-?\d*)\]")


@dataclass(frozen=True)
class Band:
    lo: int | None
    hi: int | None

    def __post_init__(self) -> None:
        if self.lo is not None and self.hi is not None and self.lo > self.hi:
            raise JoinError(f"band {self} is empty")

    def __str__(self) -> str:
        side = lambda x: "" if x is None else str(x)
        return f"[{side(self.lo)}|{side(self.hi)}]"

    def holds(self, s: Column, t: Column) -> Column:
        """The predicate on two columns; null where a side is null."""
        d = s - t
        ends = [c for c in (None if self.lo is None else d >= self.lo, None if self.hi is None else d <= self.hi) if c is not None]
        return reduce(lambda a, b: a & b, ends, d.isNotNull())


@dataclass(frozen=True)
class BandQuery:
    bands: tuple[Band, ...]

    def __post_init__(self) -> None:
        if not self.bands:
            raise JoinError("a query needs a band")

    @classmethod
    def of(cls, query: BandQuery | str | Sequence[tuple[int | None, int | None]]) -> BandQuery:
        if isinstance(query, BandQuery):
            return query
        if isinstance(query, str):
            return cls.parse(query)
        return cls(tuple(Band(lo, hi) for lo, hi in query))

    @classmethod
    def parse(cls, text: str) -> BandQuery:
        parts = text.strip().split("_")
        found = [_TEXT.fullmatch(p.strip()) for p in parts]
        if not all(found):
            raise JoinError(f"not a band query: {text!r}")
        end = lambda x: int(x) if x not in ("", "-") else None
        return cls(tuple(Band(end(m[1]), end(m[2])) for m in found))

    def __str__(self) -> str:
        return "_".join(map(str, self.bands))

    def holds(self, s: Column, t: Column) -> Column:
        return reduce(lambda a, b: a | b, [b.holds(s, t) for b in self.bands])

    def matches(self, s: Column, t: Column) -> Column:
        """How many bands hold."""
        return reduce(lambda a, b: a + b, [b.holds(s, t).cast("long") for b in self.bands])

    def merged(self) -> BandQuery:
        """The same set of differences as disjoint bands that don't touch, in order."""
        low = lambda b: -np.inf if b.lo is None else b.lo
        out: list[Band] = []
        for b in sorted(self.bands, key=low):
            last = out[-1] if out else None
            if last is not None and (last.hi is None or b.lo is None or b.lo <= last.hi + 1):
                hi = None if last.hi is None or b.hi is None else max(last.hi, b.hi)
                out[-1] = Band(last.lo, hi)
            else:
                out.append(b)
        return BandQuery(tuple(out))

    def closed(self) -> tuple[Band, ...]:
        """The bands with two ends."""
        return tuple(b for b in self.bands if b.lo is not None and b.hi is not None)

    def opened(self) -> tuple[Band, ...]:
        return tuple(b for b in self.bands if b.lo is None or b.hi is None)

    def negated(self) -> BandQuery:
        """The query with S and T exchanged."""
        flip = lambda x: None if x is None else -x
        return BandQuery(tuple(Band(flip(b.hi), flip(b.lo)) for b in self.bands))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, b.lo, b.hi) for i, b in enumerate(self.bands)], BANDS_SCHEMA)

    def cells(self, s_lo: np.ndarray, s_hi: np.ndarray, t_lo: np.ndarray, t_hi: np.ndarray) -> np.ndarray:
        """Which bucket pairs can hold a result (conservative: bucket ranges overlap the shifted ranges)."""
        out = np.zeros((len(s_lo), len(t_lo)), bool)
        for b in self.bands:
            part = np.ones_like(out)
            if b.lo is not None:
                part &= t_lo[None, :] + b.lo <= s_hi[:, None]
            if b.hi is not None:
                part &= s_lo[:, None] <= t_hi[None, :] + b.hi
            out |= part
        return out


def parse_sql(query: Column) -> Column:
    """Array of struct(lo, hi) of a column of query texts, by SQL functions."""
    parts = F.split(query, "_")
    side = lambda x, i: F.regexp_extract(x, r"\[(-?\d*)\|(-?\d*)\]", i).try_cast("long")
    return F.transform(parts, lambda x: F.struct(side(x, 1).alias("lo"), side(x, 2).alias("hi")))


def random_query(bands: int, width: int, seed: int, s_lo: Sequence[int], s_hi: Sequence[int], t_lo: Sequence[int], t_hi: Sequence[int]) -> BandQuery:
    """A seeded query of `bands` bands, each `width` buckets wide, one in each of as many equal parts of the difference range.

    The range of differences is laid out as 2 * buckets steps: the first half
    are negated S bounds from the last bucket down, the second half T bounds.
    The generator's first draw is thrown away.
    """
    k = len(s_lo)
    draw = JavaRandom(seed)
    draw.next_double()
    part = 2 * k / bands
    room = int(part) - width
    lower = [*(-x for x in reversed(s_lo)), *t_lo]
    upper = [*(-x for x in reversed(s_hi)), *t_hi]
    out = []
    for i in range(bands):
        at = int(i * part + draw.next_double() * 0.999999999 * room)
        out.append(Band(int(lower[at]), int(upper[at + width])))
    return BandQuery(tuple(out))
