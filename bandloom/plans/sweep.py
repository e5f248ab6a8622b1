"""Sweeps over planning parameters.

A sweep is a table of configurations, the cross product of the given values. All
are planned in parallel, one group each; a failure is a row with its error, never
a lost sweep, and a later call can leave out what has succeeded.
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import random_query
from ..operators.grid import Grid
from ..operators.histogram import Histogram
from . import search, seriation

CONFIG_SCHEMA = "config_id int, params map<string,string>"
RESULT_SCHEMA = "config_id int, status string, error string, ms long, metrics map<string,double>"


def configurations(spark: SparkSession, **values: Iterable[object]) -> DataFrame:
    """config_id and params of every combination, in the order of the arguments."""
    names = list(values)
    rows = [(i, {n: str(v) for n, v in zip(names, combo, strict=True)}) for i, combo in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def parameter_lines(configs: DataFrame) -> DataFrame:
    """config_id and a tab-separated line of key=value pairs, by key."""
    pairs = F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return configs.select("config_id", F.array_join(pairs, "\t").alias("line"))


def read_parameter_lines(lines: DataFrame) -> DataFrame:
    """params of lines (config_id, line)."""
    return lines.select("config_id", F.str_to_map("line", F.lit("\t"), F.lit("=")).alias("params"))


def plan_one(s: Histogram, t: Histogram, params: Mapping[str, str]) -> dict[str, float]:
    """Measures of the partitioning that a configuration describes: bands, sparsity, bandsOffsetSeed (or query), rearrangementPolicy, partitioningPolicy, numPartitions."""
    if params.get("query"):
        grid = Grid.of(s, t, params["query"])
    else:
        q = random_query(int(params["bands"]), int(params.get("sparsity", 1)), int(params.get("bandsOffsetSeed", 0)), s.lo.tolist(), s.hi.tolist(), t.lo.tolist(), t.hi.tolist())
        grid = Grid.of(s, t, q)
    if params.get("rearrangementPolicy", "none") != "none":
        grid = seriation.rearranged(grid, params["rearrangementPolicy"])
    got = search.make(grid, int(params["numPartitions"]), params.get("partitioningPolicy", "MBI"))
    return got.metrics() | {"cap": float(got.cap or 0), "candidateCells": float(grid.candidate_cells), "partitions": float(got.partitions)}


def run_plans(configs: DataFrame, s: Histogram, t: Histogram, done: DataFrame | None = None) -> DataFrame:
    """config_id, status, error, ms, metrics of each configuration that `done` (earlier results) has not as "ok"."""
    if done is not None:
        configs = configs.join(done.where("status = 'ok'").select("config_id"), "config_id", "left_anti")
    shared = configs.sparkSession.sparkContext.broadcast((s, t))  # buckets, a number that the caller chose

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, text in zip(pdf["config_id"], pdf["params"], strict=True):
            begun = time.perf_counter()
            try:
                status, error, metrics = "ok", None, plan_one(*shared.value, json.loads(text))
            except Exception as e:  # the error is the result of this configuration
                status, error, metrics = "failed", f"{type(e).__name__}: {e}", {}
            out.append((i, status, error, round((time.perf_counter() - begun) * 1000), metrics))
        return pd.DataFrame(out, columns=["config_id", "status", "error", "ms", "metrics"])

    as_text = configs.select("config_id", F.to_json("params").alias("params"))
    return as_text.groupBy("config_id").applyInPandas(one, RESULT_SCHEMA)


def job_line(params: Mapping[str, str]) -> str:
    """Parameters as a line of a parameter file."""
    return "\t".join(f"{k}={v}" for k, v in sorted(params.items()))


def run_jobs(params: Iterable[Mapping[str, str]], job: Callable[[Mapping[str, str]], object], threads: int = 4, log: str | None = None) -> list[tuple[Mapping[str, str], str, str | None]]:
    """Run Spark jobs of several configurations side by side on the driver's threads: (params, status, error).

    log: a file of the driver with the lines that have succeeded; these are left
    out ("done"), and further ones are added as they end.
    """
    lock, done = Lock(), set()
    if log is not None and Path(log).exists():
        done = set(Path(log).read_text().splitlines())

    def one(p: Mapping[str, str]) -> tuple[Mapping[str, str], str, str | None]:
        if job_line(p) in done:
            return p, "done", None
        try:
            job(p)
            if log is not None:
                with lock, Path(log).open("a") as f:
                    f.write(job_line(p) + "\n")
            return p, "ok", None
        except Exception as e:  # the error is the result of this configuration
            return p, "failed", f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, params))
