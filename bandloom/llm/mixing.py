"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source gets a share of the total size in proportion to its weight; a
source stops at max_epochs times its own size and the excess goes to the others
by weight until none is above its stop. With sources in order of stop / weight
the clamped ones are a prefix, so one pass of running sums finds the water
level. A source's goal is made of whole repetitions of all its documents and one
fractional repetition: documents in a seeded order until the rest of the goal is
used up, the last of them in part.

Documents are ordered by a seeded hash inside (source, bin), where the number of
bins is the square root of the number of rows; no task sees a whole source. Only
sums of bins are gathered by source.

Cases: null text has size 0; null source is a source of its own (last); sizes of
0 get a target of 0; repeated rows are rows like any other (rows equal in id and
size at the very end of the fractional repetition share its decision); an empty
table gives an empty table; internal columns have the prefix _bl_ and carried
columns keep their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(key: Column, seed: int) -> Column:
    """A number from 0 to 2**60 - 1 that depends on key and seed: the first 15 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, cycle: Sequence[int], max_epochs: int) -> DataFrame:
    """_bl_target of each source (src, src_null, total): one row per source, so the single ordered window is small."""
    by_name = Window.orderBy("_bl_null", "_bl_src")
    weights = F.array(*[F.lit(int(w)).cast("long") for w in cycle])
    w = sources.withColumn("_bl_w", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int")))
    w = w.withColumn("_bl_cap", F.col("_bl_total") * max_epochs)
    everything = Window.partitionBy(F.lit(1))
    before = everything.orderBy(F.col("_bl_cap") / F.col("_bl_w"), "_bl_null", "_bl_src").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("_bl_total").over(everything) - F.coalesce(F.sum("_bl_cap").over(before), F.lit(0))
    share = F.sum("_bl_w").over(everything) - F.coalesce(F.sum("_bl_w").over(before), F.lit(0))
    w = w.withColumn("_bl_full", F.col("_bl_cap") * share <= left * F.col("_bl_w"))
    free = F.sum("_bl_total").over(everything) - F.sum(F.when(F.col("_bl_full"), F.col("_bl_cap")).otherwise(0)).over(everything)
    open_ = F.sum(F.when(~F.col("_bl_full"), F.col("_bl_w")).otherwise(0)).over(everything)
    target = F.when(F.col("_bl_full"), F.col("_bl_cap").cast("double")).otherwise(free.cast("double") * F.col("_bl_w") / F.nullif(open_, F.lit(0)))
    return w.withColumn("_bl_target", F.coalesce(target, F.lit(0.0)))


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, part and taken of each row.

    copies: whole repetitions; part: words of one more, partial repetition (0:
    none); taken = copies * size + part <= max_epochs * size. carry: further
    columns to pass along; they keep their names and must not be among these.
    """
    kept = {c: F.col(c).alias(f"_bl_c_{i}") for i, c in enumerate(carry)}
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *kept.values())
    rows = rows.withColumns({"_bl_src": F.coalesce(F.col("source").cast("string"), F.lit("")), "_bl_null": F.col("source").isNull().cast("int"), "_bl_u": seeded(F.coalesce("doc_id", F.lit(-1)), seed)})
    narrow = cut(rows.drop(*[f"_bl_c_{i}" for i in range(len(kept))]))
    bins = max(1, math.isqrt(narrow.count()))
    keys = ["_bl_src", "_bl_null", "_bl_bin"]
    place = F.pmod("_bl_u", F.lit(bins))
    narrow = narrow.withColumn("_bl_bin", place)
    sums = narrow.groupBy(*keys).agg(F.sum("size").alias("_bl_sum"))
    sources = sums.groupBy("_bl_src", "_bl_null").agg(F.sum("_bl_sum").alias("_bl_total"))
    # the plan has one row per source; written once, as several later steps read it
    plan = cut(water_fill(sources, cycle, max_epochs).select("_bl_src", "_bl_null", "_bl_total", "_bl_target"))
    goal = F.floor(F.col("_bl_target") + 0.5)
    plan = plan.withColumn("_bl_copies", F.when(F.col("_bl_total") > 0, F.floor(goal / F.col("_bl_total"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_bl_rest", (goal - F.col("_bl_copies") * F.col("_bl_total")).cast("long"))
    running = Window.partitionBy("_bl_src", "_bl_null").orderBy("_bl_bin").rowsBetween(Window.unboundedPreceding, -1)
    table = sums.join(plan, ["_bl_src", "_bl_null"]).withColumn("_bl_room", F.col("_bl_rest") - F.coalesce(F.sum("_bl_sum").over(running), F.lit(0)))
    # one bin per source is used in part: there the last document taken is found
    order = F.struct("_bl_u", F.coalesce("doc_id", F.lit(-1)).alias("i"), "size")
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    edge = table.where((F.col("_bl_room") > 0) & (F.col("_bl_room") < F.col("_bl_sum"))).select(*keys, "_bl_room")
    last = narrow.join(edge, keys).withColumn("_bl_left", F.col("_bl_room") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = last.where((F.col("_bl_left") > 0) & (F.col("_bl_left") <= F.col("size"))).groupBy(*keys).agg(F.min_by(F.struct(order.alias("at"), F.col("_bl_left").alias("words")), order).alias("_bl_last"))
    table = table.join(last, keys, "left").select(*keys, "_bl_sum", "_bl_total", "_bl_target", "_bl_copies", "_bl_room", "_bl_last")
    at = F.col("_bl_last.at")
    part = (
        F.when(F.col("_bl_room") <= 0, 0)
        .when(F.col("_bl_room") >= F.col("_bl_sum"), F.col("size"))
        .when(order < at, F.col("size"))
        .when(order == at, F.col("_bl_last.words"))
        .otherwise(0)
    )
    out = rows.withColumn("_bl_bin", place) if kept else narrow
    out = out.join(table, keys).withColumn("part", part.cast("long"))
    return out.select("doc_id", "source", "size", F.col("_bl_total").alias("source_size"), F.col("_bl_target").alias("target"), F.col("_bl_copies").alias("copies"), "part", (F.col("_bl_copies") * F.col("size") + F.col("part")).alias("taken"), *[F.col(f"_bl_c_{i}").alias(c) for i, c in enumerate(kept)])


def expand(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each repetition that mix() gives, with text_col (carried) cut to its first words in a partial one.

    The words of a cut text are joined by one blank; columns are those of mixed.
    """
    turns = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("copies").cast("int")), F.when(F.col("part") > 0, F.array(F.when(F.col("part") >= F.col("size"), F.lit(-1).cast("long")).otherwise(F.col("part")))).otherwise(F.array().cast("array<long>")))
    rows = mixed.withColumn("_bl_turn", F.explode(turns))
    short = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.col("_bl_turn").cast("int")), " ")
    return rows.withColumn(text_col, F.when(F.col("_bl_turn") < 0, F.col(text_col)).otherwise(short)).drop("_bl_turn")
