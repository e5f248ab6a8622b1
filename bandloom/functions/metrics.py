"""Quality measures of a partitioning.

For a binary join (prefix BJ) and a self join (prefix SJ): input cost (IC),
candidate cells (CC), buckets (B) and buckets per cell (BdivCC) of the
partitions, each as max, min, mean, median, variance, standard deviation and
imbalance (max / mean), and the replication of IC and B. The names stdev* hold
the population variance, as users of such result files expect; stddev* hold
the standard deviation.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = {"BJ": {"IC": "input_cost", "CC": "cells", "B": "buckets"}, "SJ": {"IC": "self_input_cost", "CC": "cells", "B": "self_buckets"}}
KINDS = ("max", "min", "mean", "median", "stdev", "stddev", "imb")


def _summary(x: pd.Series) -> dict[str, float]:
    mean = float(x.mean())
    return {"max": float(x.max()), "min": float(x.min()), "mean": mean, "median": float(x.median()), "stdev": float(x.var(ddof=0)), "stddev": float(x.std(ddof=0)), "imb": float(x.max()) / mean if mean else 0.0}


def partition_metrics(costs: pd.DataFrame, size_s: int, size_t: int, buckets_s: int, buckets_t: int) -> dict[str, float]:
    """All measures of a table of per-partition costs."""
    out: dict[str, float] = {}
    for prefix, fields in FIELDS.items():
        cols = {name: costs[c].astype(float) for name, c in fields.items()}
        cols["BdivCC"] = cols["B"] / cols["CC"].where(cols["CC"] > 0, 1)
        for name, x in cols.items():
            out |= {f"{prefix}{kind}{name}": v for kind, v in _summary(x).items()}
        whole, all_buckets = (size_s + size_t, buckets_s + buckets_t) if prefix == "BJ" else (size_s, buckets_s)
        out[f"{prefix}repIC"] = float(cols["IC"].sum()) / whole if whole else 0.0
        out[f"{prefix}repB"] = float(cols["B"].sum()) / all_buckets if all_buckets else 0.0
    return out


def cost_table(assignment: DataFrame, histogram: DataFrame) -> DataFrame:
    """partition_id, input_cost, output_cost, cells, buckets, self_input_cost, self_buckets, in SQL functions."""
    s = histogram.where("rel = 'S'").select(F.col("bucket").alias("s_bucket"), F.col("cnt").alias("s_cnt"))
    t = histogram.where("rel = 'T'").select(F.col("bucket").alias("t_bucket"), F.col("cnt").alias("t_cnt"))
    cells = assignment.join(F.broadcast(s), "s_bucket").join(F.broadcast(t), "t_bucket")
    product = F.col("s_cnt").cast("decimal(38,0)") * F.col("t_cnt")
    base = cells.groupBy("partition_id").agg(F.count("*").alias("cells"), F.sum(product).cast("decimal(38,0)").alias("output_cost"))
    side = lambda b, c: cells.select("partition_id", F.col(b).alias("bucket"), F.col(c).alias("cnt")).distinct().groupBy("partition_id").agg(F.sum("cnt").alias("ic"), F.count("*").alias("n"))
    one, two = side("s_bucket", "s_cnt"), side("t_bucket", "t_cnt").withColumnsRenamed({"ic": "ic_t", "n": "n_t"})
    ids = assignment.select("partition_id", F.col("s_bucket").alias("bucket")).union(assignment.select("partition_id", "t_bucket")).distinct()
    own = ids.join(F.broadcast(s.withColumnRenamed("s_bucket", "bucket")), "bucket", "left").groupBy("partition_id").agg(F.coalesce(F.sum("s_cnt"), F.lit(0)).alias("self_input_cost"), F.count("*").alias("self_buckets"))
    rows = base.join(one, "partition_id").join(two, "partition_id").join(own, "partition_id")
    return rows.select("partition_id", (F.col("ic") + F.col("ic_t")).alias("input_cost"), "output_cost", "cells", (F.col("n") + F.col("n_t")).alias("buckets"), "self_input_cost", "self_buckets")


def metric_row(costs: DataFrame, size_s: int, size_t: int, buckets_s: int, buckets_t: int) -> DataFrame:
    """The measures as one wide row, in SQL functions."""
    out = []
    for prefix, fields in FIELDS.items():
        cols = {name: F.col(c).cast("double") for name, c in fields.items()}
        cols["BdivCC"] = cols["B"] / cols["CC"]
        for name, x in cols.items():
            made = {"max": F.max(x), "min": F.min(x), "mean": F.avg(x), "median": F.median(x), "stdev": F.var_pop(x), "stddev": F.stddev_pop(x), "imb": F.max(x) / F.avg(x)}
            out += [c.alias(f"{prefix}{kind}{name}") for kind, c in made.items()]
        whole, all_buckets = (size_s + size_t, buckets_s + buckets_t) if prefix == "BJ" else (size_s, buckets_s)
        out += [(F.sum(cols["IC"]) / whole).alias(f"{prefix}repIC"), (F.sum(cols["B"]) / all_buckets).alias(f"{prefix}repB")]
    return costs.agg(*out)


def replication_rate(costs: DataFrame, size_s: int, size_t: int) -> DataFrame:
    return costs.agg((F.sum("input_cost") / F.lit(size_s + size_t)).alias("replication_rate"))


def extremes_over_cases(cases: DataFrame, names: list[str]) -> DataFrame:
    """min_* and max_* of each measure over all cases."""
    return cases.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))])


def scored(cases: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Cases with score, the weighted sum of measures each divided by its largest value; the best (smallest) first."""
    over = Window.partitionBy(F.lit(1))
    parts = [F.lit(float(w)) * F.col(n) / F.when(F.max(n).over(over) == 0, 1.0).otherwise(F.max(n).over(over)) for n, w in sorted(weights.items())]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return cases.withColumn("score", score).orderBy("score", F.desc("cap"))


def normalized_cases(cases: DataFrame, names: list[str]) -> DataFrame:
    """Each measure divided by its largest value over the cases."""
    over = Window.partitionBy(F.lit(1))
    return cases.withColumns({n: F.col(n) / F.when(F.max(n).over(over) == 0, 1.0).otherwise(F.max(n).over(over)) for n in names})
