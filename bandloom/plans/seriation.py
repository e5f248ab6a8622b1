"""Orders of rows and columns that bring candidate cells together.

Bond energy places one row after the other where it adds most to the sum of
products of neighbouring rows. The tour methods look for a short path through
all rows, where the distance falls with the correlation of two rows; a number of
dummy rows at distance 0 from all mark where the path may be cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RearrangementError
from ..operators.grid import Grid

ORDER_SCHEMA = "axis string, pos int, bucket int"


def bonds(m: np.ndarray) -> np.ndarray:
    """Twice the inner products of all pairs of rows."""
    x = m.astype(np.float64)
    return 2 * (x @ x.T)


def radius_bonds(m: np.ndarray, radius: int) -> np.ndarray:
    """Bonds in which a product counts once for every cell nearer than radius that the row with fewer cells has."""
    x = m.astype(np.float64)
    used = x != 0
    near = np.zeros(x.shape)
    for shift in range(-(radius - 1), radius):
        moved = np.zeros(x.shape)
        if shift >= 0:
            moved[:, shift:] = used[:, : used.shape[1] - shift]
        else:
            moved[:, :shift] = used[:, -shift:]
        near += moved
    count = used.sum(1)
    out = np.zeros((len(x), len(x)))
    for a in range(len(x)):
        product = x[a] * x
        out[a] = 2 * np.where((count[a] <= count)[:, None], product * near[a], product * near).sum(1)
    return out


def bond_energy_order(bond: np.ndarray) -> np.ndarray:
    """Places row 0, then always the row and gap with the largest gain (smallest row, then first gap, at a tie)."""
    n = len(bond)
    placed, left = [0], list(range(1, n))
    while left:
        p, r = np.array(placed), np.array(left)
        gain = np.empty((len(left), len(placed) + 1))
        gain[:, 0], gain[:, -1] = bond[r, p[0]], bond[r, p[-1]]
        if len(placed) > 1:
            gain[:, 1:-1] = bond[np.ix_(r, p[:-1])] + bond[np.ix_(r, p[1:])] - bond[p[:-1], p[1:]][None, :]
        i, at = divmod(int(gain.argmax()), gain.shape[1])
        placed.insert(at, left.pop(i))
    return np.array(placed)


#: A value from here on stands for one that is missing.
MISSING = 1000


def pearson_distances(m: np.ndarray, top: int | None = 999) -> np.ndarray:
    """round(5000 - 5000 r) between rows of the matrix scaled to 0..top (None: as it is).

    Two rows are compared where neither has a missing value (MISSING or more, which
    a scaled matrix has not); r is 0 without such places and where the covariance is
    below 1e-5.
    """
    x = m.astype(np.float64)
    high = x.max(initial=0)
    x = np.floor(x * top / high) if high and top is not None else x
    known = (x < MISSING).astype(np.float64)
    x = x * known
    n = known @ known.T
    one, two = x @ known.T, (x * x) @ known.T
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = (x @ x.T - one * one.T / n) / n
        var = (two - one * one / n) / n
        r = np.where((n == 0) | ~(np.abs(cov) >= 1e-5), 0.0, cov / np.sqrt(var * var.T))
    return np.floor(5000 - 5000 * np.clip(r, -1, 1) + 0.5).astype(np.int64)


def pearson_distances_sql(cells: DataFrame, k_s: int, k_t: int, top: int = 999) -> DataFrame:
    """s1, s2, distance for all pairs s1 < s2 of the k_s rows of a sparse grid, from sums over shared columns."""
    spark = cells.sparkSession
    high = F.broadcast(cells.agg(F.max("weight").alias("high")))
    x = cells.join(high, F.lit(True)).select("s_bucket", "t_bucket", F.floor(F.col("weight") * top / F.col("high")).cast("double").alias("x"))
    rows = spark.range(k_s).select(F.col("id").cast("int").alias("s_bucket"))
    stat = rows.join(x.groupBy("s_bucket").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx")), "s_bucket", "left").fillna(0.0)
    two = x.select(F.col("s_bucket").alias("s2"), "t_bucket", F.col("x").alias("y"))
    shared = x.withColumnRenamed("s_bucket", "s1").join(two, "t_bucket").where("s1 < s2").groupBy("s1", "s2").agg(F.sum(F.col("x") * F.col("y")).alias("sxy"))
    one = stat.select(F.col("s_bucket").alias("s1"), F.col("sx").alias("a"), F.col("sxx").alias("aa"))
    other = stat.select(F.col("s_bucket").alias("s2"), F.col("sx").alias("b"), F.col("sxx").alias("bb"))
    pairs = one.join(F.broadcast(other), F.col("s1") < F.col("s2")).join(shared, ["s1", "s2"], "left").fillna(0.0, ["sxy"])
    n = F.lit(float(k_t))
    cov = F.col("sxy") / n - F.col("a") * F.col("b") / (n * n)
    va, vb = F.col("aa") / n - F.col("a") * F.col("a") / (n * n), F.col("bb") / n - F.col("b") * F.col("b") / (n * n)
    r = F.when(F.abs(cov) < 1e-5, 0.0).otherwise(cov / F.sqrt(va * vb))
    return pairs.select("s1", "s2", F.floor(F.lit(5000.0) - F.lit(5000.0) * r + 0.5).cast("long").alias("distance"))


def tour(distance: np.ndarray, dummies: int) -> np.ndarray:
    """A closed tour over all rows and dummy rows: nearest neighbour, then 2-opt until nothing improves."""
    n = len(distance)
    size = n + dummies
    far = np.zeros((size, size))
    far[:n, :n] = distance
    if dummies:
        far[n:, n:] = distance.max(initial=0) + 1.0
        np.fill_diagonal(far, 0)
    path, left = [size - 1 if dummies else 0], set(range(size))
    left.discard(path[0])
    while left:
        here = np.array(sorted(left))
        path.append(int(here[far[path[-1], here].argmin()]))
        left.discard(path[-1])
    p, better = np.array(path), True
    while better:  # every turn shortens the tour, so it ends
        better = False
        for i in range(1, size - 1):
            a, b = p[i - 1], p[i]
            ends = p[i + 1 :]
            after = np.append(p[i + 2 :], p[0])
            gain = far[a, b] + far[ends, after] - far[a, ends] - far[b, after]
            j = int(gain.argmax())
            if gain[j] > 1e-9:
                p[i : i + 2 + j] = p[i : i + 2 + j][::-1].copy()
                better = True
    return p


def cut_tour(path: np.ndarray, n: int) -> np.ndarray:
    """Rows in the order of the tour that starts after its first dummy (from its start without one)."""
    dummy = np.flatnonzero(path >= n)
    turned = np.roll(path, -int(dummy[0]) - 1) if len(dummy) else path
    return turned[turned < n]


def tour_order(m: np.ndarray, dummies: int) -> np.ndarray:
    return cut_tour(tour(pearson_distances(m), dummies), len(m))


def orders(grid: Grid, policy: str, *, radius: int = 3, dummies: int = 10) -> tuple[np.ndarray, np.ndarray | None]:
    """Order of rows, and of columns (None: as they are)."""
    m = grid.weight
    if policy == "BEA":
        return bond_energy_order(bonds(m)), bond_energy_order(bonds(m.T))
    if policy == "BEARadius":
        return bond_energy_order(radius_bonds(m, radius)), bond_energy_order(radius_bonds(m.T, radius))
    if policy == "TSPk":
        return tour_order(m, dummies), None
    if policy == "TSPkTransposedOnDefault":
        return tour_order(m, dummies), tour_order(m.T, dummies)
    if policy == "TSPkTransposedOnRearranged":
        rows = tour_order(m, dummies)
        return rows, tour_order(m[rows].T, dummies)
    raise RearrangementError(f"unknown policy {policy!r}")


def rearranged(grid: Grid, policy: str, **options) -> Grid:
    rows, cols = orders(grid, policy, **options)
    return grid.permuted(rows, cols)


def order_frame(spark: SparkSession, rows: np.ndarray, cols: np.ndarray | None = None) -> DataFrame:
    out = [("rows", i, int(b)) for i, b in enumerate(rows)]
    out += [("columns", i, int(b)) for i, b in enumerate(cols)] if cols is not None else []
    return spark.createDataFrame(out, ORDER_SCHEMA)
