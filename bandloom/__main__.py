"""Command line: python -m bandloom executionMode=… key=value …

Modes: dataGeneration, histograms, realPartitionMatrix, virtualPartitionMatrix,
rearrangement, partitioning, join. Folders are read and written through Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping

from pyspark.sql import SparkSession

from .errors import BandloomError
from .functions.bands import random_query
from .functions.metrics import normalized_cases
from .operators import bandjoin, routing
from .operators.grid import Grid
from .operators.histogram import Histogram, create_histograms, from_frame
from .plans import search, seriation
from .plans.virtual import virtual_grid
from .sources import artefacts, generators, relations


def _histograms(spark: SparkSession, folder: str) -> tuple[Histogram, Histogram]:
    bounds, counts = artefacts.read_boundaries(spark, f"{folder}/boundaries.csv"), artefacts.read_counts(spark, f"{folder}/counts.csv")
    return from_frame(bounds.join(counts, ["rel", "bucket"]))


def _grid(spark: SparkSession, folder: str) -> Grid:
    query = artefacts.read_property(spark, f"{folder}/properties.csv", "query")
    s, t = _histograms(spark, folder)
    if query and query != "no_query":
        grid = Grid.of(s, t, query)
    else:
        import numpy as np

        possible = np.zeros((len(s), len(t)), bool)
        for r in artefacts.read_grid(spark, f"{folder}/pm.csv").collect():
            possible[r["s_bucket"], r["t_bucket"]] = True
        grid = Grid.of(s, t, possible=possible)
    order = artefacts.read_property(spark, f"{folder}/properties.csv", "rearrangements")
    if order:
        rows = artefacts.read_order(spark, order).orderBy("axis", "pos").collect()
        by = {a: [r["bucket"] for r in rows if r["axis"] == a] for a in ("rows", "columns")}
        grid = grid.permuted(by["rows"] or None, by["columns"] or None)
    return grid


def _save_grid(spark: SparkSession, grid: Grid, folder: str, properties: Mapping[str, object]) -> None:
    from .operators.histogram import frame

    order = lambda h, ids: Histogram(*[x[ids.argsort()] for x in (h.lo, h.hi, h.cnt)])
    table = frame(spark, order(grid.s, grid.s_ids), order(grid.t, grid.t_ids))
    artefacts.write_boundaries(table, f"{folder}/boundaries.csv")
    artefacts.write_counts(table, f"{folder}/counts.csv")
    artefacts.write_grid(grid.frame(spark), f"{folder}/pm.csv", len(grid.s), len(grid.t))
    artefacts.write_properties(spark, properties, f"{folder}/properties.csv")


def run(spark: SparkSession, args: Mapping[str, str]) -> None:
    mode, out = args["executionMode"], args["outputDirectory"]
    times = artefacts.Timings()
    if mode == "dataGeneration":
        with times("dataGeneration"):
            lo, hi, seed = int(args["from"]), int(args["to"]), int(args.get("generatorSeed", 0))
            if args["generatorMode"] == "range":
                both = generators.generate_range(spark, lo, hi, int(args.get("valueReplication", 1)))
            else:
                both = generators.generate_distribution(spark, lo, hi, int(args["sizeS"]), int(args["sizeT"]), args["distribution"], seed)
            relations.write_tagged(both, f"{out}/dataset.csv")
            artefacts.write_sizes(relations.sizes(relations.read_tagged(spark, f"{out}/dataset.csv")), f"{out}/datasetSizes.csv")
    elif mode == "histograms":
        with times("equiDepthHistograms"):
            both = relations.read_tagged(spark, args["dataset"])
            table = create_histograms(both, int(args["buckets"]), sampling=args.get("samplingRatio", "100%")).persist()
            artefacts.write_boundaries(table, f"{out}/boundaries.csv")
            artefacts.write_counts(table, f"{out}/counts.csv")
            table.unpersist()
    elif mode in ("realPartitionMatrix", "virtualPartitionMatrix"):
        with times("partitionMatrixCreation"):
            known = {k: args[k] for k in ("buckets", "sparsity", "bands", "bandsOffsetSeed") if k in args}
            if mode == "realPartitionMatrix":
                s, t = _histograms(spark, args["histogramsDirectory"])
                q = args.get("query") or str(random_query(int(args["bands"]), int(args.get("sparsity", 1)), int(args.get("bandsOffsetSeed", 0)), s.lo.tolist(), s.hi.tolist(), t.lo.tolist(), t.hi.tolist()))
                grid = Grid.of(s, t, q)
            else:
                q, grid = "no_query", virtual_grid(int(args["buckets"]), int(args["bands"]), int(args.get("sparsity", 1)), int(args.get("bandsOffsetSeed", 0)), args.get("bandType", "normalstep"))
            _save_grid(spark, grid, out, known | {"query": q, "sizeS": grid.s.size, "sizeT": grid.t.size, "dataset": args.get("datasetDirectory", "")})
    elif mode == "rearrangement":
        folder = args["partitionMatrixDirectory"]
        with times("rearrangements"):
            grid = _grid(spark, folder)
            rows, cols = seriation.orders(grid, args["rearrangementPolicy"], dummies=int(args.get("numPartitions", 10)))
            artefacts.write_order(seriation.order_frame(spark, rows, cols), f"{out}/rearrangements.csv")
            _save_grid(spark, grid.permuted(rows, cols), out, artefacts.read_properties(spark, f"{folder}/properties.csv") | {"rearrangements": f"{out}/rearrangements.csv"})
    elif mode == "partitioning":
        grid, p, policy = _grid(spark, args["partitionMatrixDirectory"]), int(args["numPartitions"]), args["partitioningPolicy"]
        if args.get("searchPolicy", "BINARY_SEARCH") == "RANGE_SEARCH":
            factor, _, granularity = args.get("rangeSearchUpperBoundGranularity", "2.0_11").partition("_")
            with times("rangeSearch"):
                for i, weights in enumerate(search.normalized_weights(search.parse_weights(args["rangeSearchWeights"]))):
                    ranked, best = search.range_search(spark, grid, p, policy, weights, upper_factor=float(factor), granularity=int(granularity))
                    names = search.metric_names()
                    artefacts.write_cases(ranked, ["cap", *names], f"{out}/{i}/rangeSearchMetrics.csv")
                    artefacts.write_cases(normalized_cases(ranked, [*names, "score"]), ["cap", *names], f"{out}/{i}/rangeSearchMetricsNormalized.csv")
                    _save_partitioning(spark, best, f"{out}/{i}")
        else:
            with times("binarySearch"):
                got = search.make(grid, p, policy, limit=args.get("binarySearchPolicy", "MAX_PARTITION_INPUT"))
            _save_partitioning(spark, got, out)
    elif mode == "join":
        both = relations.read_tagged(spark, args["dataset"])
        s, t = relations.split(both)
        query = artefacts.read_property(spark, f"{args['partitionMatrixDirectory']}/properties.csv", "query")
        with times("join"):
            if "partitionToCellsMapping" in args:
                plan = artefacts.read_assignment(spark, args["partitionToCellsMapping"])
                hs, ht = _histograms(spark, args["partitionMatrixDirectory"])
                from .operators.histogram import frame

                table = frame(spark, hs, ht)
                pairs = routing.partitioned_join(s, t, query, table, plan, mode=args.get("joinMode", "or"))
                artefacts.write_join(pairs.drop("partition_id"), f"{out}/join", text=True)
                counted = routing.counters(s, t, query, table, plan)
                artefacts.write_counters(counted, f"{out}/counters.csv")
                artefacts.write_max_input(counted, f"{out}/maxPartitionInput.csv")
            else:
                artefacts.write_join(bandjoin.band_join_values(s, t, query), f"{out}/join", text=True)
    else:
        raise BandloomError(f"unknown executionMode {mode!r}")
    times.write(spark, f"{out}/executionTimes.csv")


def _save_partitioning(spark: SparkSession, a, folder: str) -> None:
    frame = a.frame(spark)
    artefacts.write_assignment(frame, f"{folder}/partitionToCellsMapping.csv")
    artefacts.write_partition_buckets(frame, f"{folder}/partitionToBucketsMapping.csv")
    artefacts.write_routing(a.routing(spark), f"{folder}/histogramIndexToPartitionsMapping.csv")
    artefacts.write_input_costs(spark.createDataFrame(a.costs()[["partition_id", "input_cost"]]), f"{folder}/partitionsInputCost.csv")
    artefacts.write_statistics(spark, a.metrics(), f"{folder}/partitionsStatistics.csv")
    if a.rectangles:
        artefacts.write_rectangles(a.rectangles_frame(spark), f"{folder}/partitionRectangularBoundaries.csv")


def main(argv: list[str]) -> int:
    args = dict(a.split("=", 1) for a in argv if "=" in a)
    run(SparkSession.builder.appName("bandloom").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
