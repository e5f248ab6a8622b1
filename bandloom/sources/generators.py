"""Seeded data generators for relations S and T."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BandloomError


def both_relations(df: DataFrame) -> DataFrame:
    """Each row once for S and once for T."""
    return df.withColumn("rel", F.explode(F.array(F.lit("S"), F.lit("T"))))


def generate_range(spark: SparkSession, lo: int, hi: int, copies: int = 1) -> DataFrame:
    """(rel, value): every value from lo to hi, `copies` times in each relation."""
    rows = spark.range(lo, hi + 1).select(F.col("id").alias("value"))
    if copies != 1:
        rows = rows.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("c") if copies > 1 else rows.limit(0)
    return both_relations(rows).select("rel", "value")


def uniform(u: Column) -> Column:
    return u


def gaussian(g: Column) -> Column:
    """Mean 1/2, deviation 1/6; draws outside 0 to 1 become 1/2."""
    x = g / 6 + 0.5
    return F.when((x >= 0) & (x <= 1), x).otherwise(0.5)


def power_law(u: Column) -> Column:
    """One minus the cube root of a uniform draw: density falls with the square."""
    return 1 - F.pow(u, F.lit(1 / 3))


#: The seeded draw of each distribution and what is made of it.
DISTRIBUTIONS: dict[str, tuple[Callable[[int], Column], Callable[[Column], Column]]] = {
    "UNIFORM": (F.rand, uniform),
    "GAUSSIAN": (F.randn, gaussian),
    "ZIPF": (F.rand, power_law),
}


def generate_distribution(spark: SparkSession, lo: int, hi: int, size_s: int, size_t: int, distribution: str = "UNIFORM", seed: int = 0) -> DataFrame:
    """(rel, value): size_s and size_t draws, scaled to lo..hi and truncated (hi itself has no mass)."""
    if distribution not in DISTRIBUTIONS:
        raise BandloomError(f"distribution {distribution!r} is none of {', '.join(DISTRIBUTIONS)}")

    def one(rel: str, n: int, own: int) -> DataFrame:
        # the draw gets a column of its own: a nondeterministic expression must not be evaluated twice
        draw, shape = DISTRIBUTIONS[distribution]
        drawn = spark.range(n).select(draw(own).alias("x"))
        return drawn.select(F.lit(rel).alias("rel"), (shape(F.col("x")) * (hi - lo) + lo).cast("long").alias("value"))

    return one("S", size_s, 2 * seed).unionByName(one("T", size_t, 2 * seed + 1))
