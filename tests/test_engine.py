"""The engine on Spark: joins against brute force, files, sweeps, streams, and the entry module."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.errors import JoinError
from bandloom.functions.bands import BandQuery
from bandloom.operators import bandjoin as J
from bandloom.operators import buckets as B
from bandloom.operators import histogram as H
from bandloom.operators import routing as R
from bandloom.plans import search, sweep
from bandloom.plans.plan import Plan
from bandloom.sources import artefacts, charts, generators
from bandloom.sources import relations as rel


def brute(s, t, query, per_band=False):
    out = {}
    for i, b in enumerate(BandQuery.of(query).bands):
        for x in s:
            for y in t:
                if (b.lo is None or x - y >= b.lo) and (b.hi is None or x - y <= b.hi):
                    if per_band:
                        out[i, x, y] = out.get((i, x, y), 0) + 1
                    else:
                        out.setdefault((x, y), set()).add(i)
    if per_band:
        return out
    return {k: s.count(k[0]) * t.count(k[1]) for k in out}


def frames(spark, s, t):
    make = lambda v: spark.createDataFrame([(x,) for x in v], "value long")
    return make(s), make(t)


def got(df):
    return {(r["s"], r["t"]): r["mult"] for r in df.collect()}


CASES = [([-1, -1, 0, 5], [-1, -1, 2], "[0|5]_[3|8]"), ([-9, -7, -7], [-8, -3], "[-5|1]"), ([], [1], "[0|0]"), ([3], [3, 3, 4], "[0|0]_[-1|-1]"), ([1, 2, 3], [], "[0|]"), ([2**40, -(2**40)], [2**40 - 3], "[1|4]")]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("strategy", ["auto", "cells", "naive"])
def test_value_join(spark, case, strategy):
    s, t, q = CASES[case]
    assert got(J.band_join_values(*frames(spark, s, t), q, strategy=strategy, buckets=4)) == brute(s, t, q)


def test_value_join_random(spark):
    rng = random.Random(5)
    s, t = ([rng.randint(-50, 50) for _ in range(120)] for _ in range(2))
    for q in ("[-3|4]", "[0|5]_[3|8]", "[-40|-38]_[7|7]", "[90|]", "[|-80]_[0|0]"):
        want = brute(s, t, q)
        for strategy in ("auto", "cells", "naive"):
            assert got(J.band_join_values(*frames(spark, s, t), q, strategy=strategy, buckets=7)) == want
    rows = J.band_join_values(*frames(spark, s, t), "[0|5]_[3|8]", mode="per_band").collect()
    assert {(r["band_id"], r["s"], r["t"]): r["mult"] for r in rows} == brute(s, t, "[0|5]_[3|8]", True)


def test_strategies_refuse(spark):
    s, t = frames(spark, [1], [1])
    with pytest.raises(JoinError):
        J.band_join_values(s, t, "[0|]", strategy="grid")
    with pytest.raises(JoinError):
        J.band_join_values(s, t, "[0|1]", strategy="other")


@pytest.mark.parametrize("policy", ["MBI", "AICPM", "targetf"])
def test_partitioned_join_and_counters(spark, policy):
    rng = random.Random(1)
    s, t = ([rng.choice([-1, 0, 3, *range(-30, 30)]) for _ in range(200)] for _ in range(2))
    both = rel.tagged(*frames(spark, s, t))
    plan = Plan.of(both, "[-2|3]_[20|21]", buckets=8).rearranged("BEA").partitioned(3, policy)
    assert got(plan.join()) == brute(s, t, "[-2|3]_[20|21]")
    counted = plan.counters().collect()
    assert sum(int(r["output_pairs"]) for r in counted) == sum(brute(s, t, "[-2|3]_[20|21]").values())
    a = plan.assignment
    cells = a.grid.frame(spark)
    c = R.confusion(cells, R.routing_table(a.frame(spark)), 8, 8).first()
    assert c["fn"] == 0 and c["tp"] == a.grid.candidate_cells and c["tp"] + c["tn"] + c["fp"] == 64


def test_sampled_boundaries_lose_nothing(spark):
    both = generators.generate_range(spark, -20, 400, 2)
    plan = Plan.of(both, "[0|1]", buckets=6, sampling=60, seed=3).partitioned(4)
    assert J.totals(plan.join()).first()["row_pairs"] == 4 * (421 + 420)


def test_buckets_by_a_tree_of_comparisons(spark):
    both = generators.generate_range(spark, 1, 500)
    bounds = B.literal_bounds(H.create_histograms(both, 200), "S")
    rows = spark.range(0, 503).select(F.col("id").alias("v")).select("v", B.bucket_of(F.col("v"), bounds).alias("b")).collect()
    for r in rows:
        assert r["b"] == next((i for i, (lo, hi) in enumerate(bounds) if lo <= r["v"] <= hi), -1)


@pytest.mark.parametrize("policy", ["step", "optimal", "distinct"])
def test_stored_histogram_has_the_same_bounds(spark, policy):
    rng = np.random.default_rng(3)
    rows = [(r, int(v)) for r in "ST" for v in np.concatenate([rng.integers(0, 400, 3000), np.repeat(rng.integers(0, 400, 4), 900)])]
    freq = H.frequencies(spark.createDataFrame(rows, "rel string, value long"))
    plain = sorted(map(tuple, H.boundaries(freq, 7, policy=policy).collect()))
    assert sorted(map(tuple, H.boundaries(freq, 7, policy=policy, limit=10, block=13).collect())) == plain


def test_artefacts_round_trip(spark, tmp_path):
    both = generators.generate_range(spark, 1, 60)
    plan = Plan.of(both, "[-1|1]", buckets=6).partitioned(3)
    h, a, p = plan.histogram, plan.assignment, str(tmp_path)
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.select(*x.columns).collect()))
    artefacts.write_boundaries(h, f"{p}/b")
    artefacts.write_counts(h, f"{p}/c")
    assert same(artefacts.read_boundaries(spark, f"{p}/b"), h) and same(artefacts.read_counts(spark, f"{p}/c"), h)
    cells = a.grid.frame(spark)
    artefacts.write_grid(cells, f"{p}/g", 6, 6)
    assert same(artefacts.read_grid(spark, f"{p}/g"), cells)
    artefacts.write_assignment(a.frame(spark), f"{p}/a")
    assert same(artefacts.read_assignment(spark, f"{p}/a"), a.frame(spark))
    artefacts.write_routing(a.routing(spark), f"{p}/r")
    assert {(r["rel"], r["bucket"], tuple(r["partition_ids"])) for r in artefacts.read_routing(spark, f"{p}/r").collect()} == {(r["rel"], r["bucket"], tuple(r["partition_ids"])) for r in R.routing_table(a.frame(spark)).collect()}
    artefacts.write_rectangles(a.rectangles_frame(spark), f"{p}/q")
    assert same(artefacts.read_rectangles(spark, f"{p}/q"), a.rectangles_frame(spark))
    artefacts.write_properties(spark, {"query": "[-1|1]", "x": "a,b"}, f"{p}/p")
    assert artefacts.read_property(spark, f"{p}/p", "x") == "a,b" and artefacts.read_property(spark, f"{p}/p", "none") == ""
    from bandloom.plans.seriation import order_frame

    order = order_frame(spark, [2, 0, 1], [1, 2, 0])
    artefacts.write_order(order, f"{p}/o")
    assert same(artefacts.read_order(spark, f"{p}/o"), order)
    artefacts.write_sizes(rel.sizes(both), f"{p}/s")
    assert artefacts.read_sizes(spark, f"{p}/s") == {"S": 60, "T": 60}
    (tmp_path / "tour").write_text("4\n3 0\n1 2\n")
    assert [r["city"] for r in artefacts.read_tour(spark, f"{p}/tour").orderBy("pos").collect()] == [3, 0, 1, 2]
    artefacts.write_join(plan.join(), f"{p}/j", text=True)
    assert spark.read.text(f"{p}/j").count() == 178
    artefacts.write_counters(plan.counters(), f"{p}/k")
    artefacts.write_statistics(spark, a.metrics(), f"{p}/m")
    artefacts.write_distances(R.partition_distances(a.frame(spark)), f"{p}/d")
    plan.timings.write(spark, f"{p}/t")
    assert charts.rectangle_outlines(a.rectangles_frame(spark)).count() == 5 * a.partitions
    rel.write_tagged(both, f"{p}/data")
    assert same(rel.read_tagged(spark, f"{p}/data"), both)


def test_range_search_and_sweep(spark):
    both = generators.generate_range(spark, 1, 100)
    plan = Plan.of(both, "[-1|1]", buckets=10)
    ranked, best = search.range_search(spark, plan.grid, 5, "MBI", {"BJrepIC": 0.5, "BJmaxIC": 0.5})
    scores = [r["score"] for r in ranked.collect()]
    assert scores == sorted(scores) and best.partitions <= 5
    assert charts.metric_lines(ranked, ["BJmaxIC"]).count() == len(scores)
    configs = sweep.configurations(spark, query=["[0|0]", "bad"], numPartitions=[5], partitioningPolicy=["MBI"])
    done = sweep.run_plans(configs, plan.grid.s, plan.grid.t)
    assert sorted((r["config_id"], r["status"]) for r in done.collect()) == [(0, "ok"), (1, "failed")]
    assert [r["config_id"] for r in sweep.run_plans(configs, plan.grid.s, plan.grid.t, done).collect()] == [1]
    lines = sweep.parameter_lines(configs)
    assert sweep.read_parameter_lines(lines).where("config_id = 0").first()["params"]["query"] == "[0|0]"
    assert [x[1] for x in sweep.run_jobs([{"a": "1"}, {"a": "x"}], lambda p: int(p["a"]))] == ["ok", "failed"]


def test_command_line(spark, tmp_path):
    from bandloom.__main__ import run

    p = str(tmp_path)
    run(spark, {"executionMode": "dataGeneration", "outputDirectory": f"{p}/d", "generatorMode": "range", "from": "1", "to": "100"})
    run(spark, {"executionMode": "histograms", "outputDirectory": f"{p}/h", "dataset": f"{p}/d/dataset.csv", "buckets": "10"})
    run(spark, {"executionMode": "realPartitionMatrix", "outputDirectory": f"{p}/m", "histogramsDirectory": f"{p}/h", "bands": "2", "sparsity": "1", "bandsOffsetSeed": "0"})
    assert artefacts.read_property(spark, f"{p}/m/properties.csv", "query") == "[-71|-70]_[51|70]"
    run(spark, {"executionMode": "rearrangement", "outputDirectory": f"{p}/o", "partitionMatrixDirectory": f"{p}/m", "rearrangementPolicy": "BEA"})
    run(spark, {"executionMode": "partitioning", "outputDirectory": f"{p}/p", "partitionMatrixDirectory": f"{p}/o", "numPartitions": "4", "partitioningPolicy": "MBI"})
    run(spark, {"executionMode": "join", "outputDirectory": f"{p}/j", "dataset": f"{p}/d/dataset.csv", "partitionMatrixDirectory": f"{p}/o", "partitionToCellsMapping": f"{p}/p/partitionToCellsMapping.csv"})
    assert spark.read.text(f"{p}/j/join").count() == 849 and int(spark.read.text(f"{p}/j/maxPartitionInput.csv").first()[0]) > 0
    run(spark, {"executionMode": "virtualPartitionMatrix", "outputDirectory": f"{p}/v", "buckets": "20", "bands": "3", "bandType": "randomstep"})
    run(spark, {"executionMode": "partitioning", "outputDirectory": f"{p}/w", "partitionMatrixDirectory": f"{p}/m", "numPartitions": "4", "partitioningPolicy": "AICPM", "searchPolicy": "RANGE_SEARCH", "rangeSearchWeights": "BJrepIC_1-BJmaxIC_1"})
    normal = spark.read.csv(f"{p}/w/0/rangeSearchMetricsNormalized.csv", header=True, inferSchema=True)
    assert normal.agg(F.max("BJmaxIC")).first()[0] == 1.0 and normal.count() == spark.read.csv(f"{p}/w/0/rangeSearchMetrics.csv", header=True).count()


def test_streams(spark, tmp_path):
    from bandloom.streaming.band_stream import interval_join, stream_static_join

    spark.createDataFrame([(1,), (5,), (9,)], "t long").write.parquet(f"{tmp_path}/t")
    static = spark.createDataFrame([(2, "a"), (6, "b"), (30, "c")], "s long, name string")
    stream = spark.readStream.schema("t long").parquet(f"{tmp_path}/t")
    q = stream_static_join(stream, static, "t", "s", "[1|1]").writeStream.format("memory").queryName("joined").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["s"], r["t"]) for r in spark.table("joined").collect()) == [(2, 1), (6, 5)]
    spark.sql("select id, timestamp_seconds(1000000 + id * 60) as lt from range(5)").write.parquet(f"{tmp_path}/l")
    spark.sql("select id as rid, timestamp_seconds(1000000 + id * 60) as rt from range(5)").write.parquet(f"{tmp_path}/r")
    a, b = spark.readStream.schema("id long, lt timestamp").parquet(f"{tmp_path}/l"), spark.readStream.schema("rid long, rt timestamp").parquet(f"{tmp_path}/r")
    q = interval_join(a, b, "lt", "rt", 60, 120).writeStream.format("memory").queryName("near").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["id"], r["rid"]) for r in spark.table("near").collect()) == [(i, j) for i in range(5) for j in range(5) if 1 <= i - j <= 2]


def test_bands_of_very_different_widths(spark):
    s, t = frames(spark, [0, 5, 1000, 1001, 5000, 9000], [0, 0, 4000])
    q = "[0|0]_[1000|8000]_[-3000|-2999]"
    assert got(J.band_join_values(s, t, q)) == brute([0, 5, 1000, 1001, 5000, 9000], [0, 0, 4000], q)


def test_no_nested_loop_on_the_main_path(spark):
    s, t = frames(spark, range(100), range(100))
    plan = J.band_join_values(s, t, "[1|3]_[10|12]")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("query", ["[1|3]_[10|12]", "[0|0]_[5|900]", "[20|]", "[|-15]_[3|4]", "[-2|]_[|-30]", "[|]"])
@pytest.mark.parametrize("kind", ["inner", "left_semi", "left_anti", "left_outer"])
def test_row_joins_of_every_kind(spark, query, kind):
    rng = random.Random(2)
    left = [(i, rng.choice([None, *range(-20, 20)]), "x") for i in range(60)]
    right = [(i, rng.choice([None, *range(-20, 20)])) for i in range(40)]
    s, t = spark.createDataFrame(left, "a long, v long, name string"), spark.createDataFrame(right, "b long, w long")
    holds = lambda x, y: any((b.lo is None or x - y >= b.lo) and (b.hi is None or x - y <= b.hi) for b in BandQuery.of(query).bands)
    met = {l[0]: [r for r in right if None not in (l[1], r[1]) and holds(l[1], r[1])] for l in left}  # noqa: E741
    want = {
        "inner": [(*x, *r) for x in left for r in met[x[0]]],
        "left_semi": [x for x in left if met[x[0]]],
        "left_anti": [x for x in left if not met[x[0]]],
        "left_outer": [(*x, *r) for x in left for r in met[x[0]] or [(None, None)]],
    }[kind]
    for salt in (1, 3) if kind == "inner" else (1,):
        out = J.band_join_rows(s, t, "v", "w", query, kind=kind, salt=salt, buckets=5)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_row_joins_with_an_empty_side(spark):
    s, none = spark.createDataFrame([(1, 5), (2, None)], "a long, v long"), spark.createDataFrame([], "b long, w long")
    for query in ("[0|1]", "[0|]"):
        count = lambda k, a=s, b=none, q=query: J.band_join_rows(a, b, *(("v", "w") if a is s else ("w", "v")), q, kind=k).count()
        assert [count(k) for k in ("inner", "left_semi", "left_anti", "left_outer")] == [0, 0, 2, 2]
        assert [count(k, none, s) for k in ("inner", "left_semi", "left_anti", "left_outer")] == [0, 0, 0, 0]


def test_partitioned_join_probes_ranges(spark):
    both = rel.tagged(*frames(spark, range(300), range(300)))
    plan = Plan.of(both, "[1|3]", buckets=4).partitioned(2)
    out = plan.join()
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in text and out.count() == sum(1 for x in range(300) for y in range(300) if 1 <= x - y <= 3)


def test_too_many_buckets_are_refused(spark):
    s, t = frames(spark, range(10), range(10))
    with pytest.raises(JoinError):
        J.band_join_values(s, t, "[0|]", buckets=J.MOST_BUCKETS + 1)


def test_job_log_leaves_out_what_is_done(tmp_path):
    seen, log = [], f"{tmp_path}/done"
    job = lambda p: seen.append(int(p["a"]))
    assert [x[1] for x in sweep.run_jobs([{"a": "1"}, {"a": "x"}], job, log=log)] == ["ok", "failed"]
    assert [x[1] for x in sweep.run_jobs([{"a": "1"}, {"a": "x"}, {"a": "2"}], job, log=log)] == ["done", "failed", "ok"] and seen == [1, 2]


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from bandloom import storage
    from bandloom.errors import StorageError

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(StorageError):
        storage.ensure_checkpoint_dir(Session())
    path = storage.shared_folder(spark, "own")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    monkeypatch.setattr(storage, "_made", [(spark, path)])
    storage.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_entry_module():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert "band_join_or" in q and set(o) <= set(q)


def test_limits_of_epcc_compare_cells_with_the_cap(spark, monkeypatch):
    from dataclasses import replace


    from bandloom import queries
    from bandloom.operators.grid import Grid
    from bandloom.operators.histogram import Histogram
    from bandloom.plans import merge, search

    at = np.arange(10)
    h = Histogram(10 * at + 1, 10 * at + 10, np.full(10, 10, np.int64))
    made = search.make(Grid.of(h, h, "[-1|1]"), 5, "EPCC", limit=merge.MAX_CELLS)
    cells = made.costs()["cells"]
    for cap in (made.cap, int(cells.min()), 0):
        monkeypatch.setattr(queries, "_made", lambda spark, sf_dir, policy, cap=cap: replace(made, cap=cap))
        row = queries.QUERIES["partition_limits_epcc"](spark, "").first()
        assert row["over_cap"] == (cells > cap).sum() and (cap != made.cap or row["over_cap"] == 0)


def test_theta_joins_probe_keys_and_deal_out_all_pairs(spark):
    """With keys there is no nested loop, without them the pairs are spread over tasks; results are those of the predicate."""
    from bandloom import queries

    rng = random.Random(3)
    s, t = ([rng.randint(-3000, 3000) for _ in range(300)] for _ in range(2))
    s += [-5000] * 3
    want = {(x, y): s.count(x) * t.count(y) for x in set(s) for y in set(t) if (x + y) % 10 == 0}
    rest = lambda x: F.pmod(x, F.lit(10))
    both = lambda keys: J.theta_join_values(*frames(spark, s, t), lambda x, y: (x + y) % 10 == 0, keys=keys)
    for out in (both(None), both((rest, lambda y: rest(10 - rest(y))))):
        assert got(out) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert most_in_a_task(out) < 0.4
    # one key for everything: it is cut into shares
    out = both((lambda x: x * 0, lambda y: y * 0))
    assert got(out) == want and most_in_a_task(out) < 0.4
    plan = queries.QUERIES["theta_join_custom"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got(J.theta_join_values(*frames(spark, [], [1]), lambda x, y: x == y, keys=(rest, rest))) == {}


def most_in_a_task(out):
    """The largest share of the rows that a task has made."""
    n = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def test_open_bands_are_spread_over_tasks(spark):
    s, t = frames(spark, range(1000), range(300))
    out = J.band_join_values(s, t, "[900|]", buckets=64)
    assert got(out) == {(x, y): 1 for x in range(900, 1000) for y in range(x - 899)}
    assert most_in_a_task(out) < 0.3
    # a single value on a side makes one bucket, and a plan joins its own open cells
    out = J.band_join_values(*frames(spark, range(1000), [0] * 5), "[|900]")
    assert got(out) == {(x, 0): 5 for x in range(901)} and most_in_a_task(out) < 0.3
    out = Plan.of(rel.tagged(*frames(spark, range(600), range(600))), "[500|]", buckets=4).partitioned(2).join()
    assert got(out) == {(x, y): 1 for x in range(500, 600) for y in range(x - 499)} and most_in_a_task(out) < 0.3


@pytest.mark.parametrize("kind", ["inner", "left_outer"])
def test_row_joins_are_spread_over_tasks(spark, kind):
    """Many cells, one hot value on either side, and rows without a value."""
    rows = lambda n, value, names: spark.createDataFrame([(i, value(i)) for i in range(n)], names)
    join = lambda s, t: J.band_join_rows(s, t, "v", "w", "[-3|3]", kind=kind)
    plain = join(rows(800, lambda i: i, "a long, v long"), rows(400, lambda i: 2 * i, "b long, w long"))
    met = sum(1 for x in range(800) for y in range(0, 800, 2) if abs(x - y) <= 3)
    assert plain.count() == met and most_in_a_task(plain) < 0.3
    hot = join(rows(400, lambda i: 7, "a long, v long"), rows(60, lambda i: 5 + i, "b long, w long"))
    assert hot.count() == 400 * 6 and most_in_a_task(hot) < 0.3
    if kind == "inner":
        hot = join(rows(60, lambda i: 5 + i, "a long, v long"), rows(400, lambda i: 7, "b long, w long"))
        assert hot.count() == 400 * 6 and most_in_a_task(hot) < 0.3
    else:
        null = join(rows(400, lambda i: None, "a long, v long"), rows(4, lambda i: 7, "b long, w long"))
        assert null.count() == 400 and most_in_a_task(null) < 0.3


def test_wide_bands_of_values_are_spread_over_tasks(spark):
    s, t = frames(spark, range(0, 100000, 100), range(0, 10000, 1000))
    out = J.band_join_values(s, t, "[0|100000]")
    assert out.count() == sum(1000 - 10 * i for i in range(10)) and most_in_a_task(out) < 0.3


def test_streams_are_not_counted_beforehand(spark):
    from bandloom.operators.dealing import dealt

    stream = spark.readStream.format("rate").load()
    left, right, keys = dealt(spark.range(3).withColumnRenamed("id", "value"), stream, ["value"])
    assert keys == ["value"] and right is stream


def test_nested_loops_compare_neighbours_only(spark):
    n = 20 * J.RUN
    q = BandQuery.parse("[-1|1]_[5000|5001]")
    s, t = (spark.range(n).select(F.col("id").alias(c), F.lit(1).cast("long").alias(f"{c}_freq")) for c in ("s", "t"))
    a, b = J.runs(s, "s"), J.runs(t, "t")
    assert a.agg(F.max(F.size("_rows")), F.sum(F.size("_rows"))).first()[1] == n and a.agg(F.max(F.size("_rows"))).first()[0] <= J.RUN
    # all pairs would be the product
    assert J.run_pairs(a, b, q).count() <= 6 * max(a.count(), b.count())
    out = J.band_join_values(s.select(F.col("s").alias("value")), t.select(F.col("t").alias("value")), q, strategy="naive")
    assert out.count() == n + 2 * (n - 1) + (n - 5000) + (n - 5001) and most_in_a_task(out) < 0.3
    assert out.where("s - t not in (-1, 0, 1, 5000, 5001)").count() == 0
