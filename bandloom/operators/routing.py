"""The partitioned band join: rows go to partitions, a partition joins its own cells.

A row is sent to every partition that has its bucket; rows of buckets without
candidate cells are left out before the shuffle. A pair of buckets belongs to one
cell and a cell to one partition, so each pair of rows is joined once, also where
the rows and columns of a free-form partition enclose cells of others. Within a
partition and cell, a value of S probes the range of T that a band gives it: the
cells of the band's width are in the join key (bandjoin.grid_pairs), so the work
follows the output and not the product of two buckets. Only bands with an open end,
which hold a fixed share of such a product, compare all pairs of a cell.

Tables of the plan are broadcast: at most buckets * buckets rows, so a plan may have
MOST_BUCKETS buckets a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import JoinError
from ..functions.bands import BandQuery
from .bandjoin import MOST_BUCKETS, by_width, frequency, grid_pairs, union_all
from .buckets import bucket_of, literal_bounds
from .dealing import dealt


def routing_table(assignment: DataFrame) -> DataFrame:
    """rel, bucket, partition_ids (sorted) of an assignment (partition_id, s_bucket, t_bucket)."""
    side = lambda rel, c: assignment.select(F.lit(rel).alias("rel"), F.col(c).alias("bucket"), "partition_id")
    both = side("S", "s_bucket").unionByName(side("T", "t_bucket"))
    return both.groupBy("rel", "bucket").agg(F.array_sort(F.collect_set("partition_id")).alias("partition_ids"))


def routed(values: DataFrame, rel: str, histogram: DataFrame, routing: DataFrame) -> DataFrame:
    """value, freq, bucket, partition_id: compressed rows, once for each partition that needs them."""
    own = routing.where(F.col("rel") == rel).select("bucket", "partition_ids")
    bounds = literal_bounds(histogram, rel)
    if len(bounds) > MOST_BUCKETS:
        raise JoinError(f"a plan may have {MOST_BUCKETS} buckets a side, not {len(bounds)}")
    placed = values.withColumn("bucket", bucket_of(F.col("value"), bounds))
    return placed.join(F.broadcast(own), "bucket").select("value", "freq", "bucket", F.explode("partition_ids").alias("partition_id"))


def partitioned_join(s: DataFrame, t: DataFrame, query: BandQuery | str, histogram: DataFrame, assignment: DataFrame, *, mode: str = "or", counted: bool = False) -> DataFrame:
    """partition_id, s, t, mult (and band_id in mode "per_band") of the join under an assignment.

    The tables of the plan have at most as many rows as the grid has cells.
    """
    q = BandQuery.of(query)
    s, t = (x if counted else frequency(x) for x in (s, t))
    routing = routing_table(assignment)
    a = routed(s, "S", histogram, routing).select("partition_id", F.col("bucket").alias("s_bucket"), F.col("value").alias("s"), F.col("freq").alias("s_freq"))
    b = routed(t, "T", histogram, routing).select("partition_id", F.col("bucket").alias("t_bucket"), F.col("value").alias("t"), F.col("freq").alias("t_freq"))
    # own cells only, known before the rows meet
    a = a.join(F.broadcast(assignment.select("partition_id", "s_bucket", "t_bucket")), ["partition_id", "s_bucket"])
    keys, merged = ("partition_id", "t_bucket"), q.merged()
    parts = [grid_pairs(a, b, "s", "t", g, also=keys) for g in by_width(merged.closed())]
    if opened := merged.opened():
        one, two, on = dealt(a, b, list(keys))
        parts.append(one.join(two, on).where(BandQuery(opened).holds(F.col("s"), F.col("t"))))
    pairs = union_all([p.select("partition_id", "s", "s_freq", "t", "t_freq") for p in parts])
    product = (F.col("s_freq") * F.col("t_freq")).alias("mult")
    if mode == "per_band":
        hits = F.array(*[F.when(x.holds(F.col("s"), F.col("t")), F.lit(i)) for i, x in enumerate(q.bands)])
        return pairs.select("partition_id", F.explode(F.array_compact(hits)).alias("band_id"), "s", "t", product)
    return pairs.select("partition_id", "s", "t", product)


def counters(s: DataFrame, t: DataFrame, query: BandQuery | str, histogram: DataFrame, assignment: DataFrame, *, counted: bool = False) -> DataFrame:
    """partition_id, input_rows, output_pairs (decimal) of the partitioned join."""
    s, t = (x if counted else frequency(x) for x in (s, t))
    routing = routing_table(assignment)
    read = routed(s, "S", histogram, routing).select("partition_id", "freq").unionByName(routed(t, "T", histogram, routing).select("partition_id", "freq"))
    sent = read.groupBy("partition_id").agg(F.sum("freq").alias("input_rows"))
    made = partitioned_join(s, t, query, histogram, assignment, mode="per_band", counted=True).groupBy("partition_id").agg(F.sum(F.col("mult").cast("decimal(38,0)")).alias("output_pairs"))
    zero = F.lit(0).cast("decimal(38,0)")
    return assignment.select("partition_id").distinct().join(sent, "partition_id", "left").join(made, "partition_id", "left").select("partition_id", F.coalesce("input_rows", F.lit(0)).cast("long").alias("input_rows"), F.coalesce("output_pairs", zero).cast("decimal(38,0)").alias("output_pairs"))


def confusion(cells: DataFrame, routing: DataFrame, k_s: int, k_t: int) -> DataFrame:
    """tp, tn, fp, fn over all bucket pairs: whether a pair shares a partition, against whether it is a candidate.

    fn must be 0; fp are pairs that meet without need. Grids are small (k_s * k_t rows).
    """
    spark = cells.sparkSession
    side = lambda rel, b, p: routing.where(F.col("rel") == rel).select(F.col("bucket").alias(b), F.col("partition_ids").alias(p))
    every = spark.range(k_s * k_t).select(F.floor(F.col("id") / k_t).cast("int").alias("s_bucket"), (F.col("id") % k_t).cast("int").alias("t_bucket"))
    rows = every.join(F.broadcast(side("S", "s_bucket", "sp")), "s_bucket", "left").join(F.broadcast(side("T", "t_bucket", "tp_")), "t_bucket", "left")
    rows = rows.join(F.broadcast(cells.select("s_bucket", "t_bucket", F.lit(True).alias("candidate"))), ["s_bucket", "t_bucket"], "left")
    meet, candidate = F.coalesce(F.arrays_overlap("sp", "tp_"), F.lit(False)), F.coalesce("candidate", F.lit(False))
    return rows.agg(F.count_if(meet & candidate).alias("tp"), F.count_if(~meet & ~candidate).alias("tn"), F.count_if(meet & ~candidate).alias("fp"), F.count_if(~meet & candidate).alias("fn"))


def partition_distances(assignment: DataFrame) -> DataFrame:
    """p1, p2, distance (one minus the Jaccard similarity of bucket sets) of all pairs p1 < p2 of partitions."""
    side = lambda rel, c: assignment.select("partition_id", F.lit(rel).alias("rel"), F.col(c).alias("bucket"))
    sets = side("S", "s_bucket").unionByName(side("T", "t_bucket")).distinct().groupBy("partition_id").agg(F.collect_set(F.struct("rel", "bucket")).alias("b"))
    one, two = sets.select(F.col("partition_id").alias("p1"), F.col("b").alias("x")), sets.select(F.col("partition_id").alias("p2"), F.col("b").alias("y"))
    return one.join(F.broadcast(two), F.col("p1") < F.col("p2")).select("p1", "p2", (1 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("distance"))
