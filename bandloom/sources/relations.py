"""Relations: any column as (rel, value), and tagged text files.

The join attribute is one BIGINT. Dates, timestamps, decimals and doubles come in
by a stated mapping to integers; nothing is guessed from data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAGGED = "rel string, value long"


def days(c: Column) -> Column:
    """Days since 1970-01-01 of a date or timestamp."""
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def seconds(c: Column) -> Column:
    """Seconds since 1970-01-01 of a timestamp (without a zone: taken as UTC)."""
    midnight = c.cast("date")
    clock = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return (days(midnight) * 86400 + clock).cast("long")


def scaled(c: Column, factor: int = 100) -> Column:
    """A number times factor, rounded half away from zero."""
    return F.round(c * factor).cast("long")


def values(df: DataFrame, value: Column | str) -> DataFrame:
    """One column, value BIGINT; rows whose value is null can't join and go."""
    c = F.col(value) if isinstance(value, str) else value
    return df.select(c.cast("long").alias("value")).where(F.col("value").isNotNull())


def tagged(s: DataFrame, t: DataFrame, s_value: Column | str = "value", t_value: Column | str = "value") -> DataFrame:
    """Both relations in one table (rel, value)."""
    tag = lambda d, r: d.select(F.lit(r).alias("rel"), "value")
    return tag(values(s, s_value), "S").unionByName(tag(values(t, t_value), "T"))


def split(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = lambda r: both.where(F.col("rel") == r).select("value")
    return one("S"), one("T")


def read_tagged(spark: SparkSession, path: str, *, rel_col: int = 0, value_col: int = 1) -> DataFrame:
    """Comma-separated text with the relation's tag and the value at the given places; blank lines are passed over."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split(F.trim("value"), ",")
    rows = lines.select(F.trim(parts.getItem(rel_col)).alias("rel"), F.trim(parts.getItem(value_col)).cast("long").alias("value"))
    return rows.where(F.col("rel").isin("S", "T"))


def write_tagged(both: DataFrame, path: str) -> None:
    both.select("rel", "value").write.mode("overwrite").csv(path)


def sizes(both: DataFrame) -> DataFrame:
    """rel, n for S and T; 0 for a relation without rows."""
    spark = both.sparkSession
    names = spark.createDataFrame([("S",), ("T",)], "rel string")
    counted = both.groupBy("rel").agg(F.count("*").alias("n"))
    return names.join(counted, "rel", "left").select("rel", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sample(both: DataFrame, ratio: str | int, sizes_: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """A seeded Bernoulli sample of each relation: "r%" of the rows, or about n rows of each (sizes_ as in sizes())."""
    if isinstance(ratio, str) and ratio.endswith("%"):
        share = float(ratio[:-1]) / 100
        wanted = {"S": share, "T": share}
    else:
        known = sizes_ or {r["rel"]: r["n"] for r in sizes(both).collect()}
        wanted = {r: min(1.0, int(ratio) / n) if n else 0.0 for r, n in known.items()}
    if all(p >= 1 for p in wanted.values()):
        return both
    return both.sampleBy("rel", wanted, seed)
