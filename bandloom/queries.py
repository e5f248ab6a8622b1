"""Registered queries on the test tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions.bands import BandQuery, parse_sql, random_query
from .operators import bandjoin as J
from .operators import grid as G
from .operators import histogram as H
from .operators import routing as R
from .plans import assignment as A
from .plans import merge, search, seriation, sweep, virtual
from .plans.plan import Plan
from .sources import artefacts, charts, generators
from .sources import relations as rel
from .storage import shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


# relation pairs: a frame of each side, and the SQL of the values


def _days(c: str) -> str:
    return f"date_diff('day', DATE '1970-01-01', CAST({c} AS DATE))"


def _cents(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


PAIRS: dict[str, tuple] = {
    "ship_order": (("lineitem", lambda: rel.days(F.col("l_shipdate")), _days("l_shipdate"), ""), ("orders", lambda: rel.days(F.col("o_orderdate")), _days("o_orderdate"), "")),
    "part_self": (("lineitem", lambda: F.col("l_partkey"), "l_partkey", ""), ("lineitem", lambda: F.col("l_partkey"), "l_partkey", "")),
    "acct_cents": (("customer", lambda: rel.scaled(F.col("c_acctbal")), _cents("c_acctbal"), ""), ("supplier", lambda: rel.scaled(F.col("s_acctbal")), _cents("s_acctbal"), "")),
    "event_sec": (("events", lambda: rel.seconds(F.col("ts")), "CAST(floor(epoch(ts)) AS BIGINT)", "event_type = 'click'"), ("events", lambda: rel.seconds(F.col("ts")), "CAST(floor(epoch(ts)) AS BIGINT)", "event_type = 'purchase'")),
    "price_cents": (("lineitem", lambda: rel.scaled(F.col("l_extendedprice")), _cents("l_extendedprice"), ""), ("orders", lambda: rel.scaled(F.col("o_totalprice")), _cents("o_totalprice"), "")),
}


def pair(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    def one(table: str, value: Callable, _: str, where: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return rel.values(df.where(where) if where else df, value())

    return tuple(one(*side) for side in PAIRS[name])


def both_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rel.tagged(*pair(spark, sf_dir, name))


def _side_sql(name: str, i: int) -> str:
    table, _, value, where = PAIRS[name][i]
    keep = f" WHERE {where}" if where else ""
    return f"SELECT v, count(*) AS n FROM (SELECT {value} AS v FROM {table}{keep}) WHERE v IS NOT NULL GROUP BY v"


def _condition(text: str, s: str = "s.v", t: str = "t.v") -> list[str]:
    out = []
    for b in BandQuery.of(text).bands:
        ends = ([f"{s} - {t} >= {b.lo}"] if b.lo is not None else []) + ([f"{s} - {t} <= {b.hi}"] if b.hi is not None else [])
        out.append("(" + " AND ".join(ends or ["TRUE"]) + ")")
    return out


def join_sql(name: str, text: str) -> str:
    return f"WITH s AS ({_side_sql(name, 0)}), t AS ({_side_sql(name, 1)}) SELECT s.v AS s, t.v AS t, s.n * t.n AS mult FROM s JOIN t ON {' OR '.join(_condition(text))}"


def _value_join(name: str, pair_name: str, text: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return J.band_join_values(*pair(spark, sf_dir, pair_name), text, **options)

    query(name, join_sql(pair_name, text))(run)


_value_join("band_join_or", "ship_order", "[1|3]")
_value_join("band_join_grid", "price_cents", "[-20|-10]_[5|25]", strategy="grid")
_value_join("band_join_cells", "acct_cents", "[-500|500]_[2000|3000]", strategy="cells", buckets=64)
_value_join("band_join_naive", "acct_cents", "[-100|100]", strategy="naive")
_value_join("band_join_overlapping_or", "ship_order", "[0|5]_[3|8]")
_value_join("band_join_equality", "part_self", "[0|0]")
_value_join("band_join_selfjoin", "part_self", "[-2|2]")
_value_join("band_join_open_ended", "acct_cents", "[990000|]")
_value_join("band_join_negative_values", "acct_cents", "[-300000|-299000]")
_value_join("interval_join_events", "event_sec", "[0|600]")
_value_join("interval_join_events_two_bands", "event_sec", "[-120|-60]_[60|120]")
_value_join("band_join_wide_salted_width", "price_cents", "[0|100]", width=37)


@query("band_join_per_band", "WITH s AS ({0}), t AS ({1}) ".format(_side_sql("ship_order", 0), _side_sql("ship_order", 1)) + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS band_id, s.v AS s, t.v AS t, s.n * t.n AS mult FROM s JOIN t ON {c}" for i, c in enumerate(_condition("[0|5]_[3|8]"))))
def band_join_per_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.band_join_values(*pair(spark, sf_dir, "ship_order"), "[0|5]_[3|8]", mode="per_band")


@query("theta_join_custom", f"WITH s AS ({_side_sql('event_sec', 0)}), t AS ({_side_sql('event_sec', 1)}) SELECT s.v AS s, t.v AS t, s.n * t.n AS mult FROM s JOIN t ON (s.v + t.v) % 1000 = 0")
def theta_join_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sum is divisible where the remainders of s and of -t agree
    rest = lambda x: F.pmod(x, F.lit(1000))
    return J.theta_join_values(*pair(spark, sf_dir, "event_sec"), lambda s, t: (s + t) % 1000 == 0, keys=(rest, lambda t: rest(1000 - rest(t))))


def _payload(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", rel.scaled(F.col("c_acctbal")).alias("c_cents"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", rel.scaled(F.col("s_acctbal")).alias("s_cents"))
    return c, s


_PAYLOAD = f"WITH c AS (SELECT c_custkey, {_cents('c_acctbal')} AS c_cents FROM customer), s AS (SELECT s_suppkey, {_cents('s_acctbal')} AS s_cents FROM supplier) "
_NEAR = "(c_cents - s_cents BETWEEN -1000 AND -10 OR c_cents - s_cents BETWEEN 0 AND 800)"
for _kind, _sql in {
    "inner": f"SELECT * FROM c JOIN s ON {_NEAR}",
    "left_semi": f"SELECT * FROM c WHERE EXISTS (SELECT 1 FROM s WHERE {_NEAR})",
    "left_anti": f"SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE {_NEAR})",
    "left_outer": f"SELECT * FROM c LEFT JOIN s ON {_NEAR}",
}.items():

    def _run(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return J.band_join_rows(*_payload(spark, sf_dir), "c_cents", "s_cents", "[-1000|-10]_[0|800]", kind=kind, salt=4 if kind == "inner" else 1)

    query(f"band_join_rows_{'payload' if _kind == 'inner' else _kind}", _PAYLOAD + _sql)(_run)


@query("band_join_totals", "SELECT count(*) AS value_pairs, CAST(sum(mult) AS BIGINT) AS row_pairs FROM (" + join_sql("ship_order", "[1|3]") + ")")
def band_join_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.totals(J.band_join_values(*pair(spark, sf_dir, "ship_order"), "[1|3]")).withColumn("row_pairs", F.col("row_pairs").cast("long"))


@query("band_join_generated_sql", join_sql("ship_order", "[1|3]"))
def band_join_generated_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = pair(spark, sf_dir, "ship_order")
    s.createOrReplaceTempView("bandloom_s")
    t.createOrReplaceTempView("bandloom_t")
    return spark.sql(J.band_join_sql("[1|3]", "bandloom_s", "bandloom_t"))


# the join under plans: no choice of plan changes the result

POLICIES = ("MBI", "AICPM", "AICPS", "ACCPM", "EPIC", "EPCC", "JB", "M", "WICRC_1_2", "targetf")
ORDERS = ("BEA", "BEARadius", "TSPk", "TSPkTransposedOnDefault", "TSPkTransposedOnRearranged")
_BANDS = "[1|3]_[30|33]"


def _planned(policy: str, order: str | None, sampling: str = "100%") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = Plan.of(both_of(spark, sf_dir, "ship_order"), _BANDS, buckets=12, sampling=sampling)
        if order:
            plan = plan.rearranged(order, **({"dummies": 3} if order.startswith("TSP") else {}))
        limit = merge.MAX_CELLS if policy == "EPCC" else merge.MAX_INPUT
        return plan.partitioned(4, policy, limit=limit).join()

    return run


for _p in POLICIES:
    query(f"band_join_partitioned_{_p.lower()}", join_sql("ship_order", _BANDS))(_planned(_p, None))
for _o in ORDERS:
    query(f"band_join_rearranged_{_o.lower()}", join_sql("ship_order", _BANDS))(_planned("MBI", _o))
query("band_join_sampled_hist", join_sql("ship_order", _BANDS))(_planned("MBI", None, "20%"))


@query("band_join_range_search", join_sql("ship_order", _BANDS))
def band_join_range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Plan.of(both_of(spark, sf_dir, "ship_order"), _BANDS, buckets=12).searched(4, "MBI", {"BJrepIC": 0.5, "BJmaxIC": 0.25, "BJmaxCC": 0.25}).join()


@query("partition_output_total", "SELECT CAST(sum(mult) AS BIGINT) AS output_pairs FROM (" + join_sql("ship_order", _BANDS) + ")")
def partition_output_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan.of(both_of(spark, sf_dir, "ship_order"), _BANDS, buckets=12).partitioned(4)
    return plan.counters().agg(F.sum("output_pairs").cast("long").alias("output_pairs"))


# statistics

_BOTH_SHIP = f"SELECT 'S' AS rel, v, n FROM ({_side_sql('ship_order', 0)}) UNION ALL SELECT 'T' AS rel, v, n FROM ({_side_sql('ship_order', 1)})"


@query("value_frequency", f"SELECT rel, v AS value, n AS freq FROM ({_BOTH_SHIP})")
def value_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.frequencies(both_of(spark, sf_dir, "ship_order"))


@query("relation_minmax", f"SELECT rel, min(v) AS min_value, max(v) AS max_value FROM ({_BOTH_SHIP}) GROUP BY rel")
def relation_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.extremes(H.frequencies(both_of(spark, sf_dir, "ship_order")))


@query("relation_sizes", f"SELECT rel, CAST(sum(n) AS BIGINT) AS n FROM ({_BOTH_SHIP}) GROUP BY rel")
def relation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.sizes(both_of(spark, sf_dir, "ship_order"))


@query("sample_all", f"SELECT rel, CAST(sum(n) AS BIGINT) AS n FROM ({_BOTH_SHIP}) GROUP BY rel")
def sample_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.sizes(rel.sample(both_of(spark, sf_dir, "ship_order"), "100%"))


@query("running_total", f"SELECT rel, v AS value, n AS freq, CAST(coalesce(sum(n) OVER (PARTITION BY rel ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS upto FROM ({_BOTH_SHIP})")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.running_total(H.frequencies(both_of(spark, sf_dir, "ship_order"))).select("rel", "value", "freq", F.col("upto").cast("long").alias("upto"))


def _steps_sql(k: int) -> str:
    """The walk over distinct values, one after the other, with the first target."""
    return f"""WITH RECURSIVE f AS (SELECT rel, v, n, row_number() OVER (PARTITION BY rel ORDER BY v) AS i FROM ({_BOTH_SHIP})),
    g AS (SELECT rel, CAST(sum(n) AS DOUBLE) / {k} AS goal FROM f GROUP BY rel),
    w AS (SELECT rel, i, 0 AS bucket, CAST(n AS BIGINT) AS load FROM f WHERE i = 1
      UNION ALL SELECT f.rel, f.i, CASE WHEN w.bucket < {k - 1} AND w.load >= g.goal THEN w.bucket + 1 ELSE w.bucket END, CASE WHEN w.bucket < {k - 1} AND w.load >= g.goal THEN f.n ELSE w.load + f.n END
      FROM w JOIN f ON f.rel = w.rel AND f.i = w.i + 1 JOIN g ON g.rel = w.rel),
    b AS (SELECT w.rel, CAST(bucket AS INTEGER) AS bucket, min(v) AS first, max(v) AS hi, CAST(sum(n) AS BIGINT) AS cnt FROM w JOIN f ON f.rel = w.rel AND f.i = w.i GROUP BY 1, 2),
    h AS (SELECT rel, bucket, coalesce(lag(hi) OVER (PARTITION BY rel ORDER BY bucket) + 1, first) AS lo, hi, cnt FROM b)"""


@query("equi_depth_boundaries", _steps_sql(10) + " SELECT rel, bucket, lo, hi FROM h")
def equi_depth_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.boundaries(H.frequencies(both_of(spark, sf_dir, "ship_order")), 10)


@query("bucket_counts", _steps_sql(10) + " SELECT rel, bucket, lo, hi, cnt FROM h")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.create_histograms(both_of(spark, sf_dir, "ship_order"), 10)


@query("histogram_totals_sampled", f"SELECT rel, CAST(sum(n) AS BIGINT) AS cnt, min(v) AS lo, max(v) AS hi, CAST(10 AS BIGINT) AS buckets FROM ({_BOTH_SHIP}) GROUP BY rel")
def histogram_totals_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = H.create_histograms(both_of(spark, sf_dir, "ship_order"), 10, sampling="30%", seed=4)
    return h.groupBy("rel").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("buckets"))


@query("histogram_optimal", f"SELECT rel, CAST(sum(n) AS BIGINT) AS cnt, min(v) AS lo, max(v) AS hi, CAST(10 AS BIGINT) AS buckets, CAST(0 AS BIGINT) AS moves_that_help FROM ({_BOTH_SHIP}) GROUP BY rel")
def histogram_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No boundary may be such that the sum of squared loads falls when one value goes to the next bucket or comes from it."""
    freq = written(H.frequencies(both_of(spark, sf_dir, "ship_order")))
    h = written(H.create_histograms(both_of(spark, sf_dir, "ship_order"), 10, policy="optimal", freq=freq))
    at = freq.withColumnRenamed("rel", "r").join(F.broadcast(h), (F.col("r") == F.col("rel")) & F.col("value").between(F.col("lo"), F.col("hi")))
    ends = at.groupBy("rel", "bucket", "lo", "hi", "cnt").agg(F.min_by("freq", "value").alias("first"), F.max_by("freq", "value").alias("last"))
    w = Window.partitionBy("rel").orderBy("bucket")
    gap = F.col("cnt") - F.lead("cnt").over(w)
    helps = ((gap > F.col("last")) | (-gap > F.lead("first").over(w))).cast("long")
    rows = ends.withColumn("helps", F.coalesce(helps, F.lit(0)))
    return rows.groupBy("rel").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("buckets"), F.sum("helps").alias("moves_that_help"))


@query(
    "histogram_distinct",
    f"""WITH d AS (SELECT rel, v, row_number() OVER (PARTITION BY rel ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY rel) // 10 AS step FROM ({_BOTH_SHIP})),
    e AS (SELECT rel, v AS hi, i // step AS c FROM d WHERE i % step = 0 AND i // step BETWEEN 1 AND 9 UNION ALL SELECT rel, max(v), 10 FROM d GROUP BY rel)
    SELECT rel, CAST(c - 1 AS INTEGER) AS bucket, coalesce(lag(hi) OVER (PARTITION BY rel ORDER BY c) + 1, (SELECT min(v) FROM d WHERE d.rel = e.rel)) AS lo, hi FROM e""",
)
def histogram_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.boundaries(H.frequencies(both_of(spark, sf_dir, "ship_order")), 10, policy="distinct")


_SHARE = f"SELECT rel, v, n, least(CAST(floor(coalesce(sum(n) OVER (PARTITION BY rel ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10 / CAST(sum(n) OVER (PARTITION BY rel) AS DOUBLE)) AS INTEGER), 9) AS b FROM ({_BOTH_SHIP})"


@query("histogram_by_share", f"WITH x AS (SELECT rel, b, min(v) AS lo, max(v) AS last FROM ({_SHARE}) GROUP BY rel, b) SELECT rel, CAST(row_number() OVER (PARTITION BY rel ORDER BY b) - 1 AS INTEGER) AS bucket, lo, coalesce(lead(lo) OVER (PARTITION BY rel ORDER BY b) - 1, last) AS hi FROM x")
def histogram_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.ntile_boundaries(H.frequencies(both_of(spark, sf_dir, "ship_order")), 10)


# the grid; R10: 1 to 100 in both relations, ten buckets of ten

_TEN = "WITH h AS (SELECT b, 10 * b + 1 AS lo, 10 * b + 10 AS hi, 10 AS cnt FROM generate_series(0, 9) x(b))"


def ten(spark: SparkSession, text: str) -> G.Grid:
    at = np.arange(10)
    side = H.Histogram(10 * at + 1, 10 * at + 10, np.full(10, 10, np.int64))
    return G.Grid.of(side, side, text)


def _cells_sql(text: str) -> str:
    fits = " OR ".join(f"(t.lo + {b.lo} <= s.hi AND s.lo <= t.hi + {b.hi})" for b in BandQuery.of(text).bands)
    return f"{_TEN}, c AS (SELECT CAST(s.b AS INTEGER) AS s_bucket, CAST(t.b AS INTEGER) AS t_bucket, CAST(s.cnt + t.cnt AS BIGINT) AS weight, s.cnt AS cs, t.cnt AS ct FROM h s JOIN h t ON {fits})"


@query("candidate_cells", _cells_sql("[-1|1]_[40|45]") + " SELECT s_bucket, t_bucket, weight FROM c")
def candidate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ten(spark, "[-1|1]")
    return G.candidate_cells(H.frame(spark, g.s, g.t), "[-1|1]_[40|45]")


def ship_grid(spark: SparkSession, sf_dir: str) -> G.Grid:
    """The grid of shipping and order days in ten buckets each, with the counts of the table."""
    return Plan.of(both_of(spark, sf_dir, "ship_order"), _BANDS, buckets=10).grid


def _ship_cells_sql() -> str:
    fits = " OR ".join(f"(t.lo + {b.lo} <= s.hi AND s.lo <= t.hi + {b.hi})" for b in BandQuery.of(_BANDS).bands)
    return f"{_steps_sql(10)}, c AS (SELECT s.bucket AS s_bucket, t.bucket AS t_bucket, s.cnt + t.cnt AS weight, s.cnt AS cs, t.cnt AS ct FROM h s JOIN h t ON s.rel = 'S' AND t.rel = 'T' AND ({fits}))"


@query("cell_weights", _ship_cells_sql() + " SELECT s_bucket, t_bucket, weight FROM c")
def cell_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship_grid(spark, sf_dir).frame(spark)


@query("cell_output_cost", _ship_cells_sql() + " SELECT count(*) AS cells, CAST(sum(cs * ct) AS BIGINT) AS output_cost FROM c")
def cell_output_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ship_grid(spark, sf_dir)
    return spark.createDataFrame([(g.candidate_cells, g.output_cost)], "cells long, output_cost long")


@query("brute_force_cells", "SELECT DISTINCT CAST((s.v - 1) // 10 AS INTEGER) AS s_bucket, CAST((t.v - 1) // 10 AS INTEGER) AS t_bucket FROM generate_series(1, 100) s(v) JOIN generate_series(1, 100) t(v) ON s.v - t.v BETWEEN -1 AND 1 OR s.v - t.v BETWEEN 40 AND 45")
def brute_force_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ten(spark, "[-1|1]")
    freq = H.frequencies(generators.generate_range(spark, 1, 100))
    return G.exact_cells(freq, H.frame(spark, g.s, g.t), "[-1|1]_[40|45]")


@query("matrix_dense_roundtrip", _ship_cells_sql() + " SELECT s_bucket, t_bucket, weight FROM c")
def matrix_dense_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sparse(G.dense(ship_grid(spark, sf_dir).frame(spark), 10, 10))


@query("matrix_normalized", _ship_cells_sql() + " SELECT s_bucket, t_bucket, CAST(weight * 999 // (SELECT max(weight) FROM c) AS BIGINT) AS weight FROM c")
def matrix_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.normalized(ship_grid(spark, sf_dir).frame(spark))


@query("matrix_transposed", _ship_cells_sql() + " SELECT t_bucket AS s_bucket, s_bucket AS t_bucket, weight FROM c")
def matrix_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship_grid(spark, sf_dir).transposed().frame(spark)


@query("matrix_permuted", _cells_sql("[-1|1]") + " SELECT s_bucket, t_bucket, weight, CAST(9 - s_bucket AS INTEGER) AS s_pos, t_bucket AS t_pos FROM c")
def matrix_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = seriation.order_frame(spark, np.arange(10)[::-1])
    return G.permuted_cells(ten(spark, "[-1|1]").frame(spark), order)


#: The second and third draw of the generator with seed 0.
_DRAWS = "0.24053641567148587 AS u, 0.6374174253501083 AS v"


@query(
    "virtual_matrix",
    f"""WITH d AS (SELECT CAST(floor(25 + (u - 0.5) * 25) AS INTEGER) AS r, CAST(floor(25 + (v - 0.5) * 25) AS INTEGER) AS q FROM (SELECT {_DRAWS})),
    w AS (SELECT r + i AS s, i AS t FROM d, generate_series(0, 49) x(i) UNION ALL SELECT i, q + i FROM d, generate_series(0, 49) x(i))
    SELECT DISTINCT CAST(s AS INTEGER) AS s_bucket, CAST(greatest(t - 1, 0) + k AS INTEGER) AS t_bucket, CAST(2 AS BIGINT) AS weight FROM w, generate_series(0, 2) y(k) WHERE s < 50 AND t < 50 AND greatest(t - 1, 0) + k < 50 AND greatest(t - 1, 0) + k < t + 2""",
)
def virtual_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.virtual_grid(50, 2, 3, 0, "normalstep").frame(spark)


@query("chart_points", _cells_sql("[-1|1]") + " SELECT CAST(t_bucket AS DOUBLE) AS x, CAST(-s_bucket AS DOUBLE) AS y, 'candidate' AS series FROM c")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.grid_points(ten(spark, "[-1|1]").frame(spark))


# partitionings

_WIDE = "[-1|1]"


def _made(spark: SparkSession, sf_dir: str, policy: str) -> A.Assignment:
    limit = merge.MAX_CELLS if policy == "EPCC" else merge.MAX_INPUT
    return search.make(ship_grid(spark, sf_dir), 5, policy, limit=limit)


for _p in POLICIES:

    def _cover(spark: SparkSession, sf_dir: str, policy: str = _p) -> DataFrame:
        return _made(spark, sf_dir, policy).frame(spark).select("s_bucket", "t_bucket")

    def _limits(spark: SparkSession, sf_dir: str, policy: str = _p) -> DataFrame:
        a = _made(spark, sf_dir, policy)
        over = search.coverage(a, merge.MAX_CELLS if policy == "EPCC" else merge.MAX_INPUT)["over_cap"]
        cells = a.frame(spark)
        twice = cells.groupBy("s_bucket", "t_bucket").count().where("count > 1").agg(F.count("*").alias("overlaps"))
        return twice.select("overlaps", F.lit(over).cast("long").alias("over_cap"), F.lit(max(0, a.partitions - 5)).cast("long").alias("partitions_too_many"))

    query(f"partition_coverage_{_p.lower()}", _ship_cells_sql() + " SELECT s_bucket, t_bucket FROM c")(_cover)
    query(f"partition_limits_{_p.lower()}", "SELECT CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS partitions_too_many")(_limits)


@query("routing_confusion_fn", _ship_cells_sql() + " SELECT count(*) AS tp, CAST(0 AS BIGINT) AS fn, 100 - count(*) AS others FROM c")
def routing_confusion_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _made(spark, sf_dir, "MBI")
    return R.confusion(a.grid.frame(spark), R.routing_table(a.frame(spark)), 10, 10).select("tp", "fn", (F.col("tn") + F.col("fp")).alias("others"))


#: Ten buckets a side with unequal counts, and the candidate cells of a query dealt to four partitions by their numbers.
_DEALT = (
    "WITH h AS (SELECT b, 10 * b + 1 AS lo, 10 * b + 10 AS hi, b * b + 3 AS cs, (7 * b) % 11 + 1 AS ct FROM generate_series(0, 9) x(b)), "
    "p AS (SELECT (3 * s.b + t.b * t.b) % 4 AS partition_id, s.b AS s_bucket, t.b AS t_bucket, s.cs, t.ct FROM h s JOIN h t ON (t.lo - 1 <= s.hi AND s.lo <= t.hi + 1) OR (t.lo + 40 <= s.hi AND s.lo <= t.hi + 45))"
)


def _dealt(spark: SparkSession) -> A.Assignment:
    at = np.arange(10)
    s = H.Histogram(10 * at + 1, 10 * at + 10, at * at + 3)
    t = H.Histogram(10 * at + 1, 10 * at + 10, (7 * at) % 11 + 1)
    g = G.Grid.of(s, t, "[-1|1]_[40|45]")
    return A.Assignment(g, np.where(g.possible, (3 * at[:, None] + at[None, :] ** 2) % 4, -1))


@query("routing_table", f"{_DEALT} SELECT rel, CAST(b AS INTEGER) AS bucket, string_agg(CAST(partition_id AS VARCHAR), ',' ORDER BY partition_id) AS partition_ids FROM (SELECT DISTINCT 'S' AS rel, s_bucket AS b, partition_id FROM p UNION SELECT DISTINCT 'T', t_bucket, partition_id FROM p) GROUP BY rel, b")
def routing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.routing_table(_dealt(spark).frame(spark)).select("rel", "bucket", F.array_join(F.transform("partition_ids", lambda x: x.cast("string")), ",").alias("partition_ids"))


_COSTS = (
    f"{_DEALT}, s AS (SELECT partition_id, sum(cs) AS ic, count(*) AS n FROM (SELECT DISTINCT partition_id, s_bucket, cs FROM p) GROUP BY 1), "
    "t AS (SELECT partition_id, sum(ct) AS ic, count(*) AS n FROM (SELECT DISTINCT partition_id, t_bucket, ct FROM p) GROUP BY 1), "
    "o AS (SELECT partition_id, sum(cs) AS ic, count(*) AS n FROM (SELECT DISTINCT partition_id, s_bucket AS b FROM p UNION SELECT DISTINCT partition_id, t_bucket FROM p) JOIN h USING (b) GROUP BY 1), "
    "k AS (SELECT partition_id, CAST(any_value(s.ic) + any_value(t.ic) AS DOUBLE) AS ic, CAST(count(*) AS DOUBLE) AS cc, CAST(any_value(s.n) + any_value(t.n) AS DOUBLE) AS b, CAST(any_value(o.ic) AS DOUBLE) AS sic, CAST(any_value(o.n) AS DOUBLE) AS sb, sum(cs * ct) AS oc FROM p JOIN s USING (partition_id) JOIN t USING (partition_id) JOIN o USING (partition_id) GROUP BY partition_id)"
)


def _metrics_sql(prefix: str, ic: str, b: str, size: str, buckets: int) -> str:
    parts = []
    for name, x in (("IC", ic), ("CC", "cc"), ("B", b), ("BdivCC", f"{b} / cc")):
        made = {"max": f"max({x})", "min": f"min({x})", "mean": f"avg({x})", "median": f"median({x})", "stdev": f"var_pop({x})", "stddev": f"stddev_pop({x})", "imb": f"max({x}) / avg({x})"}
        # rounded, as sums of doubles may be taken in another order
        parts += [f"round({e}, 9) AS {prefix}{k}{name}" for k, e in made.items()]
    return f"{_COSTS} SELECT {', '.join(parts)}, round(sum({ic}) / (SELECT {size} FROM h), 9) AS {prefix}repIC, round(sum({b}) / {buckets}, 9) AS {prefix}repB FROM k"


for _prefix, _args in {"BJ": ("ic", "b", "sum(cs + ct)", 20), "SJ": ("sic", "sb", "sum(cs)", 10)}.items():

    def _measure(spark: SparkSession, sf_dir: str, prefix: str = _prefix) -> DataFrame:
        a = _dealt(spark)
        row = M.metric_row(M.cost_table(a.frame(spark), H.frame(spark, a.grid.s, a.grid.t)), a.grid.s.size, a.grid.t.size, 10, 10)
        return row.select(*[F.round(c, 9).alias(c) for c in row.columns if c.startswith(prefix)])

    query(f"metrics_{_prefix.lower()}", _metrics_sql(_prefix, *_args))(_measure)


_PLANNED_COSTS = "CAST(partition_id AS INTEGER) AS partition_id, CAST(ic AS BIGINT) AS input_cost, CAST(oc AS BIGINT) AS output_cost, CAST(cc AS BIGINT) AS cells, CAST(b AS BIGINT) AS buckets, CAST(sic AS BIGINT) AS self_input_cost, CAST(sb AS BIGINT) AS self_buckets"


@query("partition_costs", f"{_COSTS} SELECT {_PLANNED_COSTS} FROM k")
def partition_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _dealt(spark)
    return M.cost_table(a.frame(spark), H.frame(spark, a.grid.s, a.grid.t)).withColumn("output_cost", F.col("output_cost").cast("long"))


@query("partition_costs_planned", f"{_COSTS} SELECT {_PLANNED_COSTS} FROM k")
def partition_costs_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_dealt(spark).costs()).select(*[F.col(c).cast("int" if c == "partition_id" else "long").alias(c) for c in ("partition_id", "input_cost", "output_cost", "cells", "buckets", "self_input_cost", "self_buckets")])


@query("replication_rate", f"{_COSTS} SELECT sum(ic) / (SELECT sum(cs + ct) FROM h) AS replication_rate FROM k")
def replication_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _dealt(spark)
    return M.replication_rate(M.cost_table(a.frame(spark), H.frame(spark, a.grid.s, a.grid.t)), a.grid.s.size, a.grid.t.size)


@query(
    "partition_distances",
    f"""{_DEALT}, e AS (SELECT DISTINCT partition_id AS p, 'S' AS rel, s_bucket AS b FROM p UNION SELECT DISTINCT partition_id, 'T', t_bucket FROM p), n AS (SELECT p, count(*) AS n FROM e GROUP BY p),
    i AS (SELECT x.p AS a, y.p AS b, count(*) AS shared FROM e x JOIN e y ON x.rel = y.rel AND x.b = y.b AND x.p < y.p GROUP BY 1, 2)
    SELECT CAST(x.p AS INTEGER) AS p1, CAST(y.p AS INTEGER) AS p2, 1 - coalesce(shared, 0) / CAST(x.n + y.n - coalesce(shared, 0) AS DOUBLE) AS distance FROM n x JOIN n y ON x.p < y.p LEFT JOIN i ON i.a = x.p AND i.b = y.p""",
)
def partition_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.partition_distances(_dealt(spark).frame(spark))


#: On the diagonal of ten equal cells a cap of c takes f = c / 20 cells, so M-Bucket-I gives 10 / f partitions, rounded up.
@query(
    "range_search_scores",
    """WITH x AS (SELECT CAST(80 - 3 * i AS BIGINT) AS cap FROM generate_series(0, 9) g(i) UNION ALL SELECT 40), y AS (SELECT cap, cap // 20 AS f FROM x)
    SELECT cap, CAST(ceil(10.0 / f) AS INTEGER) AS partitions, CAST(1 AS DOUBLE) AS BJrepIC, CAST(20 * f AS DOUBLE) AS BJmaxIC, CAST(f AS DOUBLE) AS BJmaxCC, round(0.4 + 0.6 * f / (SELECT max(f) FROM y), 9) AS score FROM y""",
)
def range_search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _ = search.range_search(spark, ten(spark, "[0|0]"), 5, "MBI", {"BJrepIC": 0.4, "BJmaxIC": 0.3, "BJmaxCC": 0.3})
    return ranked.select("cap", "partitions", "BJrepIC", "BJmaxIC", "BJmaxCC", F.round("score", 9).alias("score"))


#: The random queries of the sweep, which the query random_query checks; candidate cells follow from them.
@query(
    "sweep_results",
    f"""{_TEN}, q AS (SELECT * FROM (VALUES (0, -51, -50), (1, -21, -20), (2, -71, -70), (2, 51, 70), (3, -61, -60), (3, 11, 30)) x(i, a, z)),
    c AS (SELECT i, count(*) AS cells FROM (SELECT DISTINCT i, s.b, t.b AS tb FROM h s, h t, q WHERE t.lo + a <= s.hi AND s.lo <= t.hi + z) GROUP BY i)
    SELECT CAST(4 * i + k AS INTEGER) AS config_id, 'ok' AS status, CAST(cells AS DOUBLE) AS cells FROM c, generate_series(0, 3) y(k)""",
)
def sweep_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ten(spark, _WIDE)
    configs = sweep.configurations(spark, bands=[1, 2], bandsOffsetSeed=[0, 1], numPartitions=[3, 5], partitioningPolicy=["MBI", "AICPM"])
    return sweep.run_plans(configs, g.s, g.t).select("config_id", "status", F.col("metrics")["candidateCells"].alias("cells"))


@query("sweep_configurations", "SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS config_id, 'numPartitions=' || b || chr(9) || 'seed=' || a AS line FROM generate_series(0, 1) x(a), (VALUES (10), (20), (40)) y(b)")
def sweep_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.parameter_lines(sweep.configurations(spark, seed=[0, 1], numPartitions=[10, 20, 40]))


# orders

def _fives(spark: SparkSession) -> G.Grid:
    """Ten rows and columns of five kinds, like ones far from each other."""
    g, at = ten(spark, _WIDE), np.arange(10)
    return G.Grid.of(g.s, g.t, possible=at[:, None] % 5 == at[None, :] % 5)


for _o in ORDERS:

    def _order(spark: SparkSession, sf_dir: str, policy: str = _o) -> DataFrame:
        """An order is right if it brings all five pairs of like rows together; the given one has none together."""
        rows, cols = seriation.orders(_fives(spark), policy, **({"dummies": 2} if policy.startswith("TSP") else {}))
        order = seriation.order_frame(spark, rows, cols)
        pairs = (F.col("bucket") % 5 == F.lag("bucket").over(Window.partitionBy("axis").orderBy("pos")) % 5).cast("long")
        return order.withColumn("like", pairs).groupBy("axis").agg(F.count("*").alias("n"), F.count_distinct("bucket").alias("buckets"), F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.sum("like").alias("pairs"))

    _axes = "('rows')" if _o == "TSPk" else "('rows'), ('columns')"
    query(f"order_{_o.lower()}", f"SELECT axis, CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS buckets, CAST(0 AS INTEGER) AS low, CAST(9 AS INTEGER) AS high, CAST(5 AS BIGINT) AS pairs FROM (VALUES {_axes}) x(axis)")(_order)


@query(
    "pearson_distance",
    _cells_sql("[-1|1]")
    + ", m AS (SELECT s.b AS s_bucket, t.b AS t_bucket, CAST(CASE WHEN c.weight IS NULL THEN 0 ELSE 999 END AS DOUBLE) AS x FROM h s CROSS JOIN h t LEFT JOIN c ON c.s_bucket = s.b AND c.t_bucket = t.b) SELECT CAST(a.s_bucket AS INTEGER) AS s1, CAST(b.s_bucket AS INTEGER) AS s2, CAST(floor(5000.5 - 5000 * corr(a.x, b.x) + 1e-9) AS BIGINT) AS distance FROM m a JOIN m b ON a.t_bucket = b.t_bucket AND a.s_bucket < b.s_bucket GROUP BY 1, 2",
)
def pearson_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seriation.pearson_distances_sql(ten(spark, "[-1|1]").frame(spark), 10, 10)


# generators and texts


@query("gen_range", "SELECT rel, v AS value FROM generate_series(1, 100) x(v), (VALUES ('S'), ('T')) y(rel), generate_series(1, 3) z(i)")
def gen_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.generate_range(spark, 1, 100, 3)


#: Mean and standard deviation of the draws from 1 to 1000, by the distributions' definitions.
_MOMENTS = {"UNIFORM": (500.0, 288.4), "GAUSSIAN": (500.0, 165.5), "ZIPF": (250.3, 193.5)}

for _name in generators.DISTRIBUTIONS:

    def _gen(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        mean, spread = _MOMENTS[name]
        d = generators.generate_distribution(spark, 1, 1000, 50_000, 30_000, name, 7)
        near = lambda x, y: (F.abs(x - y) < 5).alias(f"right_{'mean' if y == mean else 'spread'}")  # noqa: B023, E731
        return d.groupBy("rel").agg(F.count("*").alias("n"), F.count_if((F.col("value") < 1) | (F.col("value") > 1000)).alias("outside"), near(F.avg("value"), mean), near(F.stddev_pop("value"), spread))

    query(f"gen_{_name.lower()}", "SELECT *, true AS right_mean, true AS right_spread FROM (VALUES ('S', CAST(50000 AS BIGINT), CAST(0 AS BIGINT)), ('T', CAST(30000 AS BIGINT), CAST(0 AS BIGINT))) x(rel, n, outside)")(_gen)


# files: written to the shared folder and read back


def _through(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    path = shared_folder(spark, "files")
    write(path)
    return read(path)


def _ship_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.create_histograms(both_of(spark, sf_dir, "ship_order"), 10)


@query("file_tagged", f"SELECT rel, v AS value, n FROM ({_BOTH_SHIP})")
def file_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = both_of(spark, sf_dir, "ship_order")
    return _through(spark, lambda p: rel.write_tagged(both, p), lambda p: rel.read_tagged(spark, p)).groupBy("rel", "value").agg(F.count("*").alias("n"))


@query("file_boundaries", _steps_sql(10) + " SELECT rel, bucket, lo, hi FROM h")
def file_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, lambda p: artefacts.write_boundaries(_ship_histogram(spark, sf_dir), p), lambda p: artefacts.read_boundaries(spark, p)).select("rel", "bucket", "lo", "hi")


@query("file_counts", _steps_sql(10) + " SELECT rel, bucket, cnt FROM h")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, lambda p: artefacts.write_counts(_ship_histogram(spark, sf_dir), p), lambda p: artefacts.read_counts(spark, p)).select("rel", "bucket", "cnt")


@query("file_matrix", _ship_cells_sql() + " SELECT s_bucket, t_bucket, weight FROM c")
def file_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ship_grid(spark, sf_dir).frame(spark)
    return _through(spark, lambda p: artefacts.write_grid(cells, p, 10, 10), lambda p: artefacts.read_grid(spark, p)).select("s_bucket", "t_bucket", "weight")


@query("file_assignment", f"{_DEALT} SELECT CAST(partition_id AS INTEGER) AS partition_id, CAST(s_bucket AS INTEGER) AS s_bucket, CAST(t_bucket AS INTEGER) AS t_bucket FROM p")
def file_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, lambda p: artefacts.write_assignment(_dealt(spark).frame(spark), p), lambda p: artefacts.read_assignment(spark, p)).select("partition_id", "s_bucket", "t_bucket")


@query("file_orders", "SELECT axis, CAST(i AS INTEGER) AS pos, CAST(CASE axis WHEN 'rows' THEN 9 - i ELSE (3 * i) % 10 END AS INTEGER) AS bucket FROM generate_series(0, 9) x(i), (VALUES ('rows'), ('columns')) y(axis)")
def file_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = seriation.order_frame(spark, np.arange(10)[::-1], 3 * np.arange(10) % 10)
    return _through(spark, lambda p: artefacts.write_order(order, p), lambda p: artefacts.read_order(spark, p)).select("axis", "pos", "bucket")


@query("file_properties", "SELECT * FROM (VALUES ('query', '[-1|1]_[40|45]'), ('sizeS', '100')) x(key, value)")
def file_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "files")
    artefacts.write_properties(spark, {"query": "[-1|1]_[40|45]", "sizeS": 100}, path)
    return spark.createDataFrame(sorted(artefacts.read_properties(spark, path).items()), "key string, value string")


@query("query_string_roundtrip", "SELECT '[-71|-70]_[51|70]' AS query, CAST(2 AS INTEGER) AS bands, CAST(-71 AS BIGINT) AS first_lo, CAST(70 AS BIGINT) AS last_hi")
def query_string_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = str(BandQuery.parse("[-71|-70]_[51|70]"))
    rows = spark.createDataFrame([(text,)], "query string").withColumn("b", parse_sql(F.col("query")))
    return rows.select("query", F.size("b").alias("bands"), F.col("b")[0]["lo"].alias("first_lo"), F.element_at("b", -1)["hi"].alias("last_hi"))


@query(
    "random_query",
    "SELECT CAST(bands AS INTEGER) AS bands, CAST(seed AS INTEGER) AS seed, query FROM (VALUES (1, 0, '[-51|-50]'), (1, 1, '[-21|-20]'), (2, 0, '[-71|-70]_[51|70]'), (2, 1, '[-61|-60]_[11|30]'), (3, 0, '[-81|-80]_[-1|10]_[61|80]'), (3, 1, '[-71|-70]_[-21|-20]_[41|60]')) x(bands, seed, query)",
)
def random_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ten(spark, "[0|0]")
    args = (g.s.lo.tolist(), g.s.hi.tolist(), g.t.lo.tolist(), g.t.hi.tolist())
    return spark.createDataFrame([(b, s, str(random_query(b, 1, s, *args))) for b in (1, 2, 3) for s in (0, 1)], "bands int, seed int, query string")
