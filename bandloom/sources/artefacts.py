"""Files that hold histograms, grids, orders, partitionings and results.

Text forms are comma-separated lines as other tools of this kind write them;
writers take any table of the stated columns and readers give it back. Every path
is the caller's.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grid as grids


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line, parts and number (in file order) of the non-empty lines; for plan files of a few hundred lines."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where(F.length(F.trim("line")) > 0)
    return rows.select(F.trim("line").alias("line"), F.split(F.trim("line"), ",").alias("parts"), "n")


def _write(lines: DataFrame, path: str, *order: Column | str) -> None:
    """One text file of the column line, in order; plan files are small."""
    lines.coalesce(1).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def _csv(*cols: Column | str) -> Column:
    return F.concat_ws(",", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).alias("line")


# sizes, histograms


def write_sizes(sizes: DataFrame, path: str) -> None:
    _write(sizes.select(_csv("rel", "n"), "rel"), path, "rel")


def read_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Sizes of S and T; -1 for a relation that the file lacks."""
    rows = _lines(spark, path).select(F.col("parts")[0].alias("rel"), F.col("parts")[1].cast("long").alias("n"), F.col("n").alias("at")).orderBy("at").collect()
    out = {"S": -1, "T": -1}
    for r in reversed(rows):
        out[r["rel"]] = r["n"]
    return out


def write_boundaries(bounds: DataFrame, path: str) -> None:
    _write(bounds.select(_csv("rel", "lo", "hi"), "rel", "bucket"), path, "rel", "bucket")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """rel, bucket (by the order of lines), lo, hi."""
    w = Window.partitionBy("rel").orderBy("n")
    rows = _lines(spark, path).withColumn("rel", F.col("parts")[0])
    return rows.select("rel", (F.row_number().over(w) - 1).cast("int").alias("bucket"), F.col("parts")[1].cast("long").alias("lo"), F.col("parts")[2].cast("long").alias("hi"))


def write_counts(histogram: DataFrame, path: str) -> None:
    _write(histogram.select(_csv("rel", "bucket", "cnt"), "rel", "bucket"), path, "rel", "bucket")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("parts")
    return _lines(spark, path).select(p[0].alias("rel"), p[1].cast("int").alias("bucket"), p[2].cast("long").alias("cnt"))


# the grid


def write_grid(cells: DataFrame, path: str, k_s: int, k_t: int) -> None:
    _write(grids.dense(cells, k_s, k_t), path, "s_bucket")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Candidate cells of a dense file."""
    w = Window.orderBy("n")
    return grids.sparse(_lines(spark, path).select((F.row_number().over(w) - 1).cast("int").alias("s_bucket"), "line"))


def write_normalized_grid(cells: DataFrame, path: str, k_s: int, k_t: int) -> None:
    write_grid(grids.normalized(cells), path, k_s, k_t)


# properties


def properties_frame(spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")


def write_properties(spark: SparkSession, values: Mapping[str, object], path: str) -> None:
    _write(properties_frame(spark, values).select(_csv("key", "value"), "key"), path, "key")


def read_properties(spark: SparkSession, path: str) -> dict[str, str]:
    """All properties; a value may hold commas."""
    rows = _lines(spark, path).select(F.regexp_extract("line", "^([^,]*),?(.*)$", 1).alias("k"), F.regexp_extract("line", "^([^,]*),?(.*)$", 2).alias("v")).collect()
    return {r["k"]: r["v"] for r in rows}


def read_property(spark: SparkSession, path: str, key: str) -> str:
    return read_properties(spark, path).get(key, "")


def upsert_property(spark: SparkSession, path: str, key: str, value: object) -> None:
    write_properties(spark, read_properties(spark, path) | {key: value}, path)


# orders


def write_order(order: DataFrame, path: str) -> None:
    """Lines "rows,…" and, if there, "columns,…" of bucket ids by place."""
    rows = order.groupBy("axis").agg(F.array_sort(F.collect_list(F.struct("pos", "bucket"))).alias("x"))
    line = F.concat_ws(",", F.col("axis"), F.array_join(F.transform("x", lambda v: v["bucket"].cast("string")), ","))
    _write(rows.select(line.alias("line"), "axis"), path, F.desc("axis"))


def read_order(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).select(F.col("parts")[0].alias("axis"), F.posexplode(F.slice("parts", 2, 1 << 30)).alias("pos", "b"))
    return rows.select("axis", "pos", F.col("b").cast("int").alias("bucket"))


def inverse_order(order: DataFrame) -> DataFrame:
    """pos of each bucket, in the same form."""
    return order.select("axis", F.col("bucket").alias("pos"), F.col("pos").alias("bucket"))


def read_tour(spark: SparkSession, path: str) -> DataFrame:
    """pos, city of a tour file: white-space separated numbers, the first of which is how many follow."""
    tokens = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.slice(tokens, 2, 1 << 30)).alias("pos", "c"))
    return rows.select("pos", F.col("c").cast("int").alias("city"))


# partitionings


def write_rectangles(rectangles: DataFrame, path: str) -> None:
    line = F.format_string("%d,[[%d,%d],[%d,%d]]", "partition_id", "row_lo", "col_lo", "row_hi", "col_hi")
    _write(rectangles.select(line.alias("line"), "partition_id"), path, "partition_id")


def read_rectangles(spark: SparkSession, path: str) -> DataFrame:
    n = F.transform(F.regexp_extract_all("line", F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("int"))
    return _lines(spark, path).select(*[n[i].alias(c) for i, c in enumerate(("partition_id", "row_lo", "col_lo", "row_hi", "col_hi"))])


def write_assignment(assignment: DataFrame, path: str) -> None:
    """Lines "partition,row,column,row,column,…"."""
    rows = assignment.groupBy("partition_id").agg(F.array_sort(F.collect_list(F.struct("s_bucket", "t_bucket"))).alias("x"))
    line = F.concat_ws(",", F.col("partition_id").cast("string"), F.array_join(F.transform("x", lambda v: F.concat_ws(",", v["s_bucket"].cast("string"), v["t_bucket"].cast("string"))), ","))
    _write(rows.select(line.alias("line"), "partition_id"), path, "partition_id")


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("parts")
    rows = _lines(spark, path).select(p[0].cast("int").alias("partition_id"), "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2))).alias("i"))
    return rows.select("partition_id", F.get("parts", F.col("i")).cast("int").alias("s_bucket"), F.get("parts", F.col("i") + 1).cast("int").alias("t_bucket"))


def write_partition_buckets(assignment: DataFrame, path: str) -> None:
    """Lines "partition,S,bucket,…" and "partition,T,bucket,…"."""
    side = lambda rel, c: assignment.select("partition_id", F.lit(rel).alias("rel"), F.col(c).alias("bucket"))
    rows = side("S", "s_bucket").unionByName(side("T", "t_bucket")).groupBy("partition_id", "rel").agg(F.array_sort(F.collect_set("bucket")).alias("b"))
    line = F.concat_ws(",", F.col("partition_id").cast("string"), "rel", F.array_join(F.transform("b", lambda x: x.cast("string")), ","))
    _write(rows.select(line.alias("line"), "partition_id", "rel"), path, "partition_id", "rel")


def write_routing(routing: DataFrame, path: str) -> None:
    """Lines "rel,bucket,partition,partition,…"."""
    line = F.concat_ws(",", "rel", F.col("bucket").cast("string"), F.array_join(F.transform("partition_ids", lambda x: x.cast("string")), ","))
    _write(routing.select(line.alias("line"), "rel", "bucket"), path, "rel", "bucket")


def read_routing(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("parts")
    return _lines(spark, path).select(p[0].alias("rel"), p[1].cast("int").alias("bucket"), F.transform(F.slice("parts", 3, 1 << 30), lambda x: x.cast("int")).alias("partition_ids"))


def write_input_costs(costs: DataFrame, path: str) -> None:
    _write(costs.select(_csv("partition_id", "input_cost"), "partition_id"), path, "partition_id")


def write_statistics(spark: SparkSession, metrics: Mapping[str, float], path: str) -> None:
    """Lines "metric,value" by name."""
    rows = spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double")
    _write(rows.select(_csv("metric", "value"), "metric"), path, "metric")


def write_distances(distances: DataFrame, path: str) -> None:
    """Lines "p1:[p1,p2,d]…" with 16 decimals."""
    entry = F.format_string("[%d,%d,%.16f]", "p1", "p2", "distance")
    rows = distances.groupBy("p1").agg(F.array_sort(F.collect_list(F.struct("p2", entry.alias("e")))).alias("x"))
    line = F.concat(F.col("p1").cast("string"), F.lit(":"), F.array_join(F.transform("x", lambda v: v["e"]), ""))
    _write(rows.select(line.alias("line"), "p1"), path, "p1")


def write_cases(cases: DataFrame, names: Iterable[str], path: str) -> None:
    """Range-search cases with a header of measures and score."""
    cases.select(*names, "score").coalesce(1).sortWithinPartitions("score").write.mode("overwrite").csv(path, header=True)


# results and timings


def write_join(pairs: DataFrame, path: str, *, text: bool = False) -> None:
    """Join results as Parquet, or as tab-separated lines s, t, mult."""
    if text:
        pairs.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("s", "t", "mult")]).alias("line")).write.mode("overwrite").text(path)
    else:
        pairs.write.mode("overwrite").parquet(path)


def write_counters(counters: DataFrame, path: str, overflow: int = 2**63 - 1) -> None:
    """Lines "partition,input,overflows,output": the output as how often it fills a signed 64-bit number, and the rest."""
    full = F.floor(F.col("output_pairs") / F.lit(overflow).cast("decimal(20,0)")).cast("decimal(20,0)")
    rest = F.col("output_pairs") - full * F.lit(overflow).cast("decimal(20,0)")
    _write(counters.select(_csv("partition_id", "input_rows", full, rest), "partition_id"), path, "partition_id")


def join_statistics(counters: DataFrame, size_s: int, size_t: int) -> DataFrame:
    """max_partition_input and replication_rate of a join that ran."""
    return counters.agg(F.max("input_rows").alias("max_partition_input"), (F.sum("input_rows") / F.lit(max(1, size_s + size_t))).alias("replication_rate"))


def write_max_input(counters: DataFrame, path: str) -> None:
    """One line: the rows that the largest partition of a join read."""
    _write(counters.agg(F.coalesce(F.max("input_rows"), F.lit(0)).cast("string").alias("line")), path, "line")


class Timings:
    """Milliseconds by stage; stages are timed with `with timings("name"):`."""

    def __init__(self) -> None:
        self.ms: dict[str, int] = {}

    @contextmanager
    def __call__(self, stage: str) -> Iterator[None]:
        begun = time.perf_counter()
        try:
            yield
        finally:
            self.ms[stage] = self.ms.get(stage, 0) + round((time.perf_counter() - begun) * 1000)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.ms.items()), "stage string, ms long")

    def write(self, spark: SparkSession, path: str) -> None:
        _write(self.frame(spark).select(_csv("stage", "ms"), "stage"), path, "stage")
