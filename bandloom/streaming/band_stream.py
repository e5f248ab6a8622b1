"""Band joins on streams.

A stream of T rows against a static S: the grid form needs no state, each
micro-batch joins on its own. Two streams on event time: both sides carry
watermarks, and the band on seconds bounds how long rows are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import JoinError
from ..functions.bands import BandQuery
from ..operators.bandjoin import band_join_rows


def stream_static_join(stream: DataFrame, static: DataFrame, stream_value: str, static_value: str, query: BandQuery | str) -> DataFrame:
    """Rows of both sides with lo <= static - stream <= hi; bands must be closed."""
    q = BandQuery.of(query).merged()
    if any(b.lo is None or b.hi is None for b in q.bands):
        raise JoinError("a stream needs bands that are closed on both ends")
    return band_join_rows(static, stream, static_value, stream_value, q)


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, lo: int, hi: int, *, delay: str = "10 minutes") -> DataFrame:
    """Rows of two streams with lo <= left_time - right_time <= hi seconds (inner)."""
    w = hi - lo + 1
    cell = lambda x: x - F.pmod(x, F.lit(w).cast("long"))
    at = lambda t: F.unix_seconds(t.cast("timestamp"))
    # streams join on an equality: the cells of time that the band reaches
    a = left.withWatermark(left_time, delay).withColumn("_cell", cell(at(F.col(left_time)))).alias("l")
    reach = F.sequence(cell(at(F.col(right_time)) + lo), cell(at(F.col(right_time)) + hi), F.lit(w).cast("long"))
    b = right.withWatermark(right_time, delay).withColumn("_cell", F.explode(reach)).alias("r")
    x, y = F.col(f"l.{left_time}"), F.col(f"r.{right_time}")
    step = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))
    out = a.join(b, (F.col("l._cell") == F.col("r._cell")) & (x >= y + step(lo)) & (x <= y + step(hi)))
    return out.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns])


def windowed_frequencies(stream: DataFrame, time: str, value: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Frequencies of values by window of event time, for histograms that follow a stream."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), F.col(value).alias("value")).agg(F.count("*").alias("freq"))
