"""Band joins as equi-joins with a residual.

Spark has no range join: a band predicate alone is a nested loop. Here every join
gets an equality that Catalyst can hash or sort on, and keeps the band as a
residual predicate.

* grid: s falls into a cell of w values, t reaches the cells of t + lo to t + hi.
  With w the width of the band t reaches two or three cells, and a cell has no
  more s than a small multiple of the matches, so the work follows the output.
* cells: both sides get the bucket of an equi-depth histogram and meet through
  the candidate bucket pairs. It serves open-ended bands, of whose pairs a fixed
  share is output, and plans made from statistics; closed bands have the grid's
  cell in the key as well, so that a bucket pair is probed and not multiplied out.
* partitioned: rows are sent to the partitions of a given assignment, and a
  partition probes only its own cells (see routing.py).
* naive: the predicate alone, on all pairs of two runs of neighbouring values; run
  pairs whose ends allow no match are left out (a millionth of all pairs is compared
  for that).

Row joins use the same keys with Spark's own join kinds. For an open end a row of
the left side has a partner if the smallest or largest value of the right side is
one, so semi and anti joins need that one number. Their sides are plain exchanges,
whose hot keys AQE splits. Inner and outer joins are dealt out by the pairs that keys
hold (dealing.py); salt= splits keys beforehand.

Values are compressed (one row per distinct value with its frequency) below the
join wherever rows are not asked for. Bands that overlap or touch are merged
first in mode "or", so a pair comes once; in mode "per_band" it comes once for
each band, with band_id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import JoinError
from ..functions.bands import Band, BandQuery
from ..storage import written
from .buckets import bucket_of, literal_bounds
from .dealing import dealt, in_blocks, places
from .histogram import boundaries, frequencies, widened

STRATEGIES = ("auto", "grid", "cells", "naive")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def frequency(values: DataFrame) -> DataFrame:
    """value, freq of a one-column relation."""
    return values.groupBy("value").agg(F.count("*").alias("freq"))


def width_of(band: Band) -> int:
    return band.hi - band.lo + 1


def by_width(bands: tuple[Band, ...]) -> list[tuple[Band, ...]]:
    """Bands in groups whose widths differ by less than a factor of 64; each group is one join."""
    groups: dict[int, list[Band]] = {}
    for b in bands:
        groups.setdefault(width_of(b).bit_length() // 6, []).append(b)
    return [tuple(g) for g in groups.values()]


def grid_pairs(s: DataFrame, t: DataFrame, sv: str, tv: str, bands: tuple[Band, ...], width: int | None = None, salt: int = 1, kind: str = "inner", also: tuple[str, ...] = (), distinct: bool = True) -> DataFrame:
    """Rows that any of the disjoint closed bands joins, by one join: a row of t is repeated for every cell that a band reaches.

    also: further columns of equal names that must agree; they come from s.
    distinct: a value has one row for each of `also`, so that a cell holds no more than its width.
    """
    w = width or max(map(width_of, bands))
    cell = lambda x: x - F.pmod(x, F.lit(w))  # noqa: E731  the cell's first value: exact for any BIGINT
    left = s.withColumn("_cell", cell(F.col(sv)))
    reach = [F.sequence(cell(F.col(tv) + b.lo), cell(F.col(tv) + b.hi), F.lit(w).cast("long")) for b in bands]
    right = t.withColumn("_cell", F.explode(reach[0] if len(reach) == 1 else F.array_distinct(F.concat(*reach))))
    keys = ["_cell", *also]
    if salt > 1:  # rows of a hot value are spread by a hash of the row, and the other side is repeated for each share
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*s.columns), F.lit(salt)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys.append("_salt")
    if kind in ("inner", "left_outer"):
        left, right, keys = dealt(left, right, keys, spread=not distinct or w > WIDE, both=kind == "inner")
    a, b = left.alias("_l"), right.alias("_r")
    held = BandQuery(bands).holds(F.col(f"_l.{sv}"), F.col(f"_r.{tv}"))
    out = a.join(b, reduce(lambda x, y: x & y, [F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in keys]) & held, kind)
    own = [F.col(f"_l.{c}") for c in s.columns]
    return out.select(*own) if kind in ("left_semi", "left_anti") else out.select(*own, *[F.col(f"_r.{c}") for c in t.columns if c not in also])


def _sides(s: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    return s.select(F.col("value").alias("s"), F.col("freq").alias("s_freq")), t.select(F.col("value").alias("t"), F.col("freq").alias("t_freq"))


#: A cell with more values than this may hold too many pairs for one task.
WIDE = 4096

#: Buckets a side of a join by cells: the table of candidate cells, at most their square, is broadcast.
MOST_BUCKETS = 1024


def _placed(s: DataFrame, t: DataFrame, sv: str, tv: str, query: BandQuery, buckets: int, counted: bool) -> tuple[DataFrame, DataFrame] | None:
    """s with s_bucket and t_bucket (a row for each candidate cell), and t with t_bucket; None if a side has no value."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise JoinError(f"a join by cells takes 1 to {MOST_BUCKETS} buckets a side")
    side = lambda df, v, r, f: df.where(F.col(v).isNotNull()).select(F.lit(r).alias("rel"), F.col(v).alias("value"), F.col(f) if counted else F.lit(1).cast("long").alias("freq")).groupBy("rel", "value").agg(F.sum(F.col(f) if counted else F.col("freq")).alias("freq"))
    both = written(side(s, sv, "S", "s_freq").unionByName(side(t, tv, "T", "t_freq")))
    found = {r["rel"]: r for r in both.groupBy("rel").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    if len(found) < 2:
        return None
    k = min(buckets, *(r["n"] for r in found.values()))
    if k < 2:  # one value on a side: one bucket a side
        bounds = {r: ((found[r]["lo"], found[r]["hi"]),) for r in found}
    else:
        histogram = written(widened(boundaries(both, k), both))
        bounds = {r: literal_bounds(histogram, r) for r in found}
    ends = [np.array(bounds[r], np.int64).T for r in ("S", "T")]
    pairs = np.argwhere(query.cells(*ends[0], *ends[1])).tolist()
    cells = s.sparkSession.createDataFrame(pairs, "s_bucket int, t_bucket int")
    left = s.withColumn("s_bucket", bucket_of(F.col(sv), bounds["S"])).join(F.broadcast(cells), "s_bucket")
    return left, t.withColumn("t_bucket", bucket_of(F.col(tv), bounds["T"]))


def cells_join(s: DataFrame, t: DataFrame, sv: str, tv: str, query: BandQuery, buckets: int, counted: bool = True) -> DataFrame:
    """Rows of s and t that meet through the candidate cells of histograms made of their values (frequencies s_freq and t_freq, if counted)."""
    placed = _placed(s, t, sv, tv, query, buckets, counted)
    columns = [*s.columns, *t.columns]
    if placed is None:
        return s.where("false").join(t.where("false"), F.col(sv) == F.col(tv)).select(*columns)
    left, right = placed
    closed, opened = query.closed(), query.opened()
    parts = [grid_pairs(left, right, sv, tv, g, also=("t_bucket",)) for g in by_width(closed)]
    if opened:
        one, two, keys = dealt(left, right, ["t_bucket"])
        parts.append(one.join(two, keys).where(BandQuery(opened).holds(F.col(sv), F.col(tv))))
    return union_all([p.select(*columns) for p in parts])


#: Values in a run of a nested loop, a power of two.
RUN = 1024


def runs(values: DataFrame, v: str) -> DataFrame:
    """_run, _lo, _hi, _rows: the rows in runs of at most RUN neighbours by v (written, as their numbers depend on the run of the job)."""
    placed = values.where(F.col(v).isNotNull()).repartitionByRange(places(values.sparkSession), v).sortWithinPartitions(v, *values.columns)
    # the number's lower 33 bits are the place within the partition
    numbered = placed.withColumn("_run", F.shiftright(F.monotonically_increasing_id(), RUN.bit_length() - 1))
    return written(numbered.groupBy("_run").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.collect_list(F.struct(*values.columns)).alias("_rows")))


def run_pairs(s: DataFrame, t: DataFrame, q: BandQuery) -> DataFrame:
    """_s_run, _t_run: runs of both sides that may hold a match, by their ends."""
    fits = F.lit(False)
    for b in q.bands:
        low = F.lit(True) if b.lo is None else F.col("_s_hi") - F.col("_t_lo") >= b.lo
        high = F.lit(True) if b.hi is None else F.col("_s_lo") - F.col("_t_hi") <= b.hi
        fits = fits | (low & high)
    ends = lambda df, x: df.select(F.col("_run").alias(f"_{x}_run"), F.col("_lo").alias(f"_{x}_lo"), F.col("_hi").alias(f"_{x}_hi"))
    one = ends(s, "s").repartition(places(s.sparkSession), "_s_run")
    return one.join(F.broadcast(ends(t, "t")), fits).select("_s_run", "_t_run")


def runs_join(s: DataFrame, t: DataFrame, q: BandQuery) -> DataFrame:
    """All pairs for which the predicate holds, by nested loops over pairs of runs: the work follows the values that are near each other."""
    a, b = runs(s, "s"), runs(t, "t")
    one, two = a.select(F.col("_run").alias("_s_run"), F.col("_rows").alias("_s_rows")), b.select(F.col("_run").alias("_t_run"), F.col("_rows").alias("_t_rows"))
    met = run_pairs(a, b, q).join(one, "_s_run").join(two, "_t_run")
    # each pair of runs is at most RUN * RUN comparisons, so any even deal will do
    met = met.repartition(places(s.sparkSession), "_s_run", "_t_run")
    every = met.select(F.explode("_s_rows").alias("_s"), "_t_rows").select("_s", F.explode("_t_rows").alias("_t"))
    rows = every.select(*[F.col(f"_s.{c}").alias(c) for c in s.columns], *[F.col(f"_t.{c}").alias(c) for c in t.columns])
    return rows.where(q.holds(F.col("s"), F.col("t")))


def band_join_values(s: DataFrame, t: DataFrame, query: BandQuery | str, *, mode: str = "or", strategy: str = "auto", counted: bool = False, buckets: int = 256, width: int | None = None) -> DataFrame:
    """s, t, mult (and band_id in mode "per_band"): the value pairs of a band join and how many row pairs each stands for.

    s, t: relations with a column value; counted: with a column freq as well.
    """
    q = BandQuery.of(query)
    if strategy not in STRATEGIES:
        raise JoinError(f"strategy {strategy!r} is none of {', '.join(STRATEGIES)}")
    s, t = (x if counted else frequency(x) for x in (s, t))
    product = (F.col("s_freq") * F.col("t_freq")).alias("mult")
    if mode == "per_band":
        hits = F.array(*[F.when(b.holds(F.col("s"), F.col("t")), F.lit(i)) for i, b in enumerate(q.bands)])
        return _join(s, t, q.merged(), strategy, buckets, width).select(F.explode(F.array_compact(hits)).alias("band_id"), "s", "t", product)
    if mode != "or":
        raise JoinError(f"mode {mode!r} is neither 'or' nor 'per_band'")
    return _join(s, t, q.merged(), strategy, buckets, width).select("s", "t", product)


def _join(s: DataFrame, t: DataFrame, q: BandQuery, strategy: str, buckets: int, width: int | None) -> DataFrame:
    a, b = _sides(s, t)
    if strategy == "naive":
        return runs_join(a, b, q)
    if strategy == "cells":
        return cells_join(a, b, "s", "t", q, buckets)
    opened = q.opened()
    if opened and strategy == "grid":
        raise JoinError("the grid strategy needs bands that are closed on both ends")
    return _parts(a, b, "s", "t", q, buckets, width)


def _parts(s: DataFrame, t: DataFrame, sv: str, tv: str, q: BandQuery, buckets: int, width: int | None, salt: int = 1, counted: bool = True) -> DataFrame:
    """Closed bands by the grid, open ones by cells."""
    parts = [grid_pairs(s, t, sv, tv, g, width, salt, distinct=counted) for g in by_width(q.closed())]
    if opened := q.opened():
        parts.append(cells_join(s, t, sv, tv, BandQuery(opened), buckets, counted))
    return union_all(parts)


def _without(s: DataFrame, t: DataFrame, sv: str, tv: str, q: BandQuery, width: int | None) -> DataFrame:
    """Rows of s that no band joins with a row of t."""
    out = s
    for g in by_width(q.closed()):
        out = grid_pairs(out, t, sv, tv, g, width, kind="left_anti")
    for b in q.opened():
        out = out.where(~F.coalesce(_beyond(t, sv, tv, b), F.lit(False)))
    return out


def _beyond(t: DataFrame, sv: str, tv: str, b: Band) -> Column:
    """Whether an open band joins a value with any of t: the smallest or largest of these settles it (a scalar subquery)."""
    end = t.agg((F.max(tv) if b.lo is None and b.hi is not None else F.min(tv)).alias("_end")).scalar()
    return b.holds(F.col(sv), end)


def band_join_rows(s: DataFrame, t: DataFrame, s_value: str, t_value: str, query: BandQuery | str, *, kind: str = "inner", width: int | None = None, salt: int = 1, buckets: int = 256) -> DataFrame:
    """Rows of both sides with all their columns (which must differ in name): inner, left_semi, left_anti or left_outer.

    Values must be BIGINT; rows with a null value match nothing.
    """
    q = BandQuery.of(query).merged()
    if kind == "left_anti":
        return _without(s, t, s_value, t_value, q, width)
    if kind == "left_semi":
        # a row is given by the first group of bands that joins it
        out, rest = [], s
        for g in [*by_width(q.closed()), *((b,) for b in q.opened())]:
            own = BandQuery(g)
            if own.closed():
                out.append(grid_pairs(rest, t, s_value, t_value, g, width, kind="left_semi"))
            else:
                out.append(rest.where(_beyond(t, s_value, t_value, g[0])))
            rest = _without(rest, t, s_value, t_value, own, width)
        return union_all(out)
    if kind not in ("inner", "left_outer"):
        raise JoinError(f"kind {kind!r} is not supported")
    groups = by_width(q.closed())
    if kind == "left_outer" and len(groups) == 1 and not q.opened():
        return grid_pairs(s, t, s_value, t_value, groups[0], width, salt=1, kind="left_outer", distinct=False)
    inner = _parts(s, t, s_value, t_value, q, buckets, width, salt, counted=False)
    return inner if kind == "inner" else inner.unionByName(_without(s, t, s_value, t_value, q, width), allowMissingColumns=True)


def theta_join_values(s: DataFrame, t: DataFrame, predicate, *, keys=None, counted: bool = False) -> DataFrame:
    """Any predicate on two columns, over compressed values: s, t, mult.

    keys: a function of s and one of t whose values are equal wherever the predicate
    holds; the join then probes these keys. Without them all pairs are compared, in
    blocks of bounded size.
    """
    a, b = _sides(*(x if counted else frequency(x) for x in (s, t)))
    if keys is None:
        left, right, on = in_blocks(a, b)
    else:
        left, right, on = dealt(a.withColumn("_key", keys[0](F.col("s"))), b.withColumn("_key", keys[1](F.col("t"))), ["_key"])
    return left.join(right, on).where(predicate(F.col("s"), F.col("t"))).select("s", "t", (F.col("s_freq") * F.col("t_freq")).alias("mult"))


def totals(pairs: DataFrame) -> DataFrame:
    """value_pairs and row_pairs of a join result; the sum is a decimal, which can't overflow here."""
    return pairs.agg(F.count("*").alias("value_pairs"), F.coalesce(F.sum(F.col("mult").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("row_pairs"))


def band_join_sql(query: BandQuery | str, s_table: str = "s", t_table: str = "t", value: str = "value") -> str:
    """The join as SQL text over two tables with a value column (closed bands), in the grid form."""
    parts = []
    for b in BandQuery.of(query).merged().bands:
        if b.lo is None or b.hi is None:
            raise JoinError("SQL text needs bands that are closed on both ends")
        w = width_of(b)
        parts.append(
            f"SELECT s.{value} AS s, t.{value} AS t, s.n * t.n AS mult FROM (SELECT {value}, count(*) AS n, {value} - pmod({value}, {w}) AS cell FROM {s_table} GROUP BY {value}) s "
            f"JOIN (SELECT {value}, n, explode(sequence({value} + {b.lo} - pmod({value} + {b.lo}, {w}), {value} + {b.hi} - pmod({value} + {b.hi}, {w}), {w})) AS cell FROM (SELECT {value}, count(*) AS n FROM {t_table} GROUP BY {value})) t "
            f"ON s.cell = t.cell AND s.{value} - t.{value} BETWEEN {b.lo} AND {b.hi}"
        )
    return " UNION ALL ".join(parts)


__all__ = ["STRATEGIES", "band_join_rows", "band_join_sql", "band_join_values", "bucket_of", "frequencies", "frequency", "literal_bounds", "theta_join_values", "totals"]
