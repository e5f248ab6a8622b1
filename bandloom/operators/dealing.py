"""How the sides of a join are dealt out where its output is larger than its input.

AQE sizes the partitions of a join by the bytes they read, and a join that makes
thousands of rows from one would end up in a few long tasks. So both sides (either
may be the one that is not broadcast) go to a fixed number of partitions, and a key that holds more than a fair part of the
pairs is cut into shares: rows of its larger side are spread by a hash of the row,
and its smaller side is repeated for each share.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def places(spark: SparkSession) -> int:
    """Partitions of a side that is dealt out: four for each core at least, so that their sizes level out."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def row_hash(df: DataFrame) -> Column:
    """A hash of the row (of the columns that can be hashed)."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])


def shares(left: DataFrame, right: DataFrame, keys: list[str], both: bool = True) -> DataFrame:
    """The keys with more than a fair part of all pairs, so at most twice the number of places: keys, _shares, _by_left.

    both: whether the rows of the right side may be the ones that are spread.
    """
    count = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    pairs = count(left, "_a").join(count(right, "_b"), keys).withColumn("_pairs", F.col("_a").cast("double") * F.col("_b"))
    fair = pairs.agg((F.sum("_pairs") / (2 * places(left.sparkSession))).alias("_fair")).scalar()
    by_left = F.col("_a") >= F.col("_b") if both else F.lit(True)
    most = F.when(by_left, F.col("_a")).otherwise(F.col("_b"))
    hot = pairs.where(F.col("_pairs") > fair)
    return hot.select(*keys, F.least(F.ceil(F.col("_pairs") / fair), most).cast("int").alias("_shares"), by_left.alias("_by_left"))


def dealt(left: DataFrame, right: DataFrame, keys: list[str], *, spread: bool = True, both: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the keys on which they meet; streams, which can't be counted beforehand, are left as they are.

    spread: cut keys with many pairs into shares (not needed where keys hold little); both: as in shares().
    """
    if left.isStreaming or right.isStreaming:
        return left, right, keys
    if spread:
        hot = F.broadcast(shares(left, right, keys, both))
        every = F.sequence(F.lit(0), F.col("_shares") - 1)

        def cut(df: DataFrame, own: Column) -> DataFrame:
            one = F.array(F.pmod(row_hash(df), F.col("_shares")).cast("int"))
            # rows without a key meet nothing; an outer join keeps them, so they are spread as well
            none = F.when(F.col(keys[0]).isNull(), F.pmod(row_hash(df), F.lit(places(df.sparkSession)))).otherwise(0).cast("int")
            share = F.when(F.col("_shares").isNull(), F.array(none)).when(own, one).otherwise(every)
            return df.join(hot, keys, "left").withColumn("_share", F.explode(share)).drop("_shares", "_by_left")

        left, right = cut(left, F.col("_by_left")), cut(right, ~F.col("_by_left"))
        keys = [*keys, "_share"]
    n = places(left.sparkSession)
    return left.repartition(n, *keys), right.repartition(n, *keys), keys


def in_blocks(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sides that meet in all pairs of their rows: each is hashed into blocks, and every two blocks have a key."""
    n = places(left.sparkSession)
    blocks = ceil((4 * n) ** 0.5)
    own = lambda df: F.pmod(row_hash(df), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = left.withColumn("_i", own(left)).withColumn("_j", every)
    right = right.withColumn("_j", own(right)).withColumn("_i", every)
    return left.repartition(n, "_i", "_j"), right.repartition(n, "_i", "_j"), ["_i", "_j"]
