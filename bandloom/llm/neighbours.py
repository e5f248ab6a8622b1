"""Approximate nearest neighbours: hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample (at most `sample` vectors, a parameter)
by recursive k-means; every row is then put in the leaf that a greedy descent
reaches. A query walks the tree with a priority queue keyed by the distance to
cluster centres: the nearest unopened node is opened next, and leaves are
visited in that order. The number of leaves to visit is calibrated: sample
vectors are searched in the sample by brute force, and visits are widened until
the mean share of true neighbours in the visited leaves reaches `recall`. Leaves
are fitted for half the square root of all rows each, 8 at least and 512 at most;
beyond what the sample can place (64 sample vectors a leaf), leaves grow. Where the
sample is not the whole table, a quarter of it is kept from the fit, and visits are
calibrated on that quarter alone.

A query goes on beyond that number while its leaves hold fewer than k sample
rows. The sample rows in its leaves give each query a distance within which k
rows lie that it searches, and no leaf returns rows beyond it.

Neighbouring leaves of the tree form groups of about PART rows. A row goes to its
group once; a query goes once to each group that has leaves which it visits, with
the numbers of these, and is compared with the rows of these leaves only. A leaf of
more rows, and more queries of a group than that, are split by a hash of the id, so
hot ones are spread over tasks. Distances are computed in double precision on the
original vectors.

Cases: vectors that are null, empty, all zero or hold null or non-finite
components, and rows without an id, take no part; rows that share the query's id
count as the query's own row; a repeated query row counts once, and rows that share
an id and differ are one query with several vectors, each of which can bring a row
into the list; vectors of another dimension than the sample's
most frequent one are searched among themselves, exactly; ties go to the smaller
vec_id; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import best_of, by_dimension, clean, lists

PART = 4096


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of at most k non-empty clusters."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = total[n > 0] / n[n > 0][:, None]
    return c


@dataclass
class Tree:
    """Nodes: centres of the children and either their node numbers or (negative) leaf numbers."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaves: int
    visits: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, leaf: int, fan: int, seed: int) -> Tree:
        rng, tree = np.random.default_rng(seed), cls([], [], 0)

        def grow(part: np.ndarray) -> int:
            if len(part) > leaf:
                c = k_means(part, fan, rng)
                own = distances(part, c).argmin(1)
                if len(np.unique(own)) > 1:
                    me = len(tree.centres)
                    tree.centres.append(c)
                    tree.children.append([])
                    tree.children[me] = [grow(part[own == i]) for i in range(len(c))]
                    return me
            tree.leaves += 1
            return -tree.leaves

        root = grow(x)
        if root < 0:
            tree.centres, tree.children = [x[:1]], [[-1]]
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector (from 0)."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            own = distances(x[rows], self.centres[node]).argmin(1)
            for i, child in enumerate(self.children[node]):
                part = rows[own == i]
                if child < 0:
                    out[part] = -child - 1
                else:
                    stack.append((child, part))
        return out

    def visit(self, q: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves, best bin first, and further ones until together they hold `least` rows (held: rows of each leaf)."""
        heap, out, have = [(0.0, 0)], [], 0
        while heap and (len(out) < most or have < least):
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(-node - 1)
                have += int(held[-node - 1]) if held is not None else least
                continue
            d = ((self.centres[node] - q) ** 2).sum(1)
            for i, child in enumerate(self.children[node]):
                heapq.heappush(heap, (float(d[i]), child))
        return out

    def calibrate(self, x: np.ndarray, k: int, recall: float, probes: int, seed: int) -> None:
        """Widen the visits until the visited leaves hold the wanted share of the true neighbours."""
        rng = np.random.default_rng(seed + 1)
        rows = rng.choice(len(x), min(probes, len(x)), replace=False)
        own = self.assign(x)
        d = distances(x[rows], x)
        d[np.arange(len(rows)), rows] = np.inf
        near = np.argsort(d, 1, kind="stable")[:, : min(k, len(x) - 1)]
        found = np.zeros(self.leaves)
        for r, row in enumerate(rows):
            turn = np.full(self.leaves, self.leaves - 1)
            walk = self.visit(x[row], self.leaves)
            turn[walk] = np.arange(len(walk))
            np.add.at(found, turn[own[near[r]]], 1)
        share = np.cumsum(found) / max(1, near.size)
        self.visits = int(min(self.leaves, np.searchsorted(share, recall) + 1))


def fit_tree(rows: DataFrame, *, k: int, sample: int, recall: float, fan: int = 8, probes: int = 512, seed: int = 5) -> tuple[int, Tree | None, np.ndarray, np.ndarray]:
    """Dimension, calibrated tree, ids and vectors of at most about `sample` rows (vec_id, vec), chosen by a hash of the id, one for each id."""
    nothing = (0, None, np.zeros(0, np.int64), np.zeros((0, 0)))
    total = rows.count()
    if not total:
        return nothing
    unit = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 20))
    chosen = rows.where(unit < max(1, min(1 << 20, int((1 << 20) * sample / total))))
    got = chosen.groupBy("vec_id").agg(F.min("vec").alias("vec")).toArrow()
    if not got.num_rows:
        return nothing
    values, off = lists(got["vec"].combine_chunks())
    dims, n = np.unique(np.diff(off), return_counts=True)
    dim = int(dims[n.argmax()])
    own = np.diff(off) == dim
    x, ids = values[off[:-1][own][:, None] + np.arange(dim)], got["vec_id"].to_numpy()[own]
    order = np.lexsort((ids, *x.T[::-1]))  # the same tree whatever the order of the rows
    x, ids = x[order], ids[order]
    each = min(512, max(8, math.isqrt(total) // 2))
    if len(x) == total or len(x) < 256:  # the sample is all there is
        tree = Tree.fit(x, max(min(16, each), len(x) * each // total), fan, seed)
        tree.calibrate(x, k, recall, probes, seed)
        return dim, tree, ids, x
    # visits are calibrated on vectors that the tree has not seen, as it has not seen most rows
    unseen = np.random.default_rng(seed + 2).random(len(x)) < 0.25
    tree = Tree.fit(x[~unseen], max(64, int((~unseen).sum()) * each // total), fan, seed)
    tree.calibrate(x[unseen], k, recall, probes, seed)
    return dim, tree, ids, x


def within(q: np.ndarray, qid: np.ndarray, walk: list[list[int]], x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, leaves: int, k: int) -> np.ndarray:
    """For each query a squared distance within which k sample rows lie in the leaves it visits (so k of all rows searched do), with room for rounding."""
    out = np.full(len(q), np.inf)
    if len(x) >= k:
        for a in range(0, len(q), 256):
            seen = np.zeros((len(q[a : a + 256]), leaves), bool)
            for i, w in enumerate(walk[a : a + 256]):
                seen[i, w] = True
            d = distances(q[a : a + 256], x)
            d[~seen[:, leaf] | (qid[a : a + 256][:, None] == ids[None, :])] = np.inf
            out[a : a + 256] = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-9 * (1 + (q[a : a + 256] ** 2).sum(1) + (x * x).sum(1).max())
    return out


def nearest(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, sample: int = 8192, recall: float = 0.95, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance): the k nearest rows found of each row whose id is divisible by `every`."""
    spark = df.sparkSession
    rows = clean(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    shared = spark.sparkContext.broadcast(fit_tree(rows, k=k, sample=sample, recall=recall, seed=seed))  # bounded by the sample

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, tree, _, _ = shared.value
        for batch in batches:
            for ids, mat in by_dimension(batch):
                leaf = tree.assign(mat) if mat.shape[1] == dim else np.full(len(ids), -mat.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(mat), pa.list_(pa.float64())), pa.array(leaf)], ["vec_id", "vec", "leaf"])

    index = rows.mapInArrow(leaf_of, "vec_id long, vec array<double>, leaf long")
    # rows of each leaf: one row per leaf, at most as many as the sample allows (and one per odd dimension)
    sizes = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    group_of, parts, held = {}, [], PART
    for leaf in sorted(sizes):
        if leaf < 0 or held + sizes[leaf] > PART:
            parts.append(0)
            held = 0
        group_of[leaf] = len(parts) - 1
        held = held + sizes[leaf] if leaf >= 0 else PART
        parts[-1] += sizes[leaf]
    c_parts = [-(-n // PART) for n in parts]
    grouped = spark.sparkContext.broadcast(group_of)

    def visits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, tree, some, x = shared.value
        own = tree.assign(x) if tree else np.zeros(0, np.int64)
        held, some_ids = np.bincount(own, minlength=tree.leaves if tree else 0), np.sort(some)
        for batch in batches:
            for ids, mat in by_dimension(batch):
                if mat.shape[1] == dim:
                    # k sample rows beside those that have the query's id
                    least = k + np.searchsorted(some_ids, ids, "right") - np.searchsorted(some_ids, ids, "left")
                    walk = [tree.visit(v, tree.visits, held, n) for v, n in zip(mat, least, strict=True)]
                    most = within(mat, ids, walk, x, some, own, tree.leaves, k)
                else:
                    walk, most = [[-mat.shape[1]]] * len(ids), np.full(len(ids), np.inf)
                at, group, leaves = [], [], []
                for i, w in enumerate(walk):
                    of: dict[int, list[int]] = {}
                    for leaf in w:
                        if leaf in grouped.value:
                            of.setdefault(grouped.value[leaf], []).append(leaf)
                    at += [i] * len(of)
                    group += of
                    leaves += of.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(list(mat[at]), pa.list_(pa.float64())), pa.array(group, pa.int32()), pa.array(leaves, pa.list_(pa.int64())), pa.array(most[at])], ["vec_id", "vec", "grp", "leaves", "most"])

    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"]).mapInArrow(visits_of, "vec_id long, vec array<double>, grp int, leaves array<long>, most double")
    q_parts = {r["grp"]: -(-r["count"] // PART) for r in asked.groupBy("grp").count().collect()}
    table = [(leaf, g, c_parts[g], q_parts[g]) for leaf, g in group_of.items() if g in q_parts]
    split = spark.createDataFrame(table or [(0, 0, 1, 1)], "leaf long, grp int, c_parts int, q_parts int")
    by_group = F.broadcast(split.select("grp", "c_parts", "q_parts").distinct())
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["grp", "cp", "qp"]
    left = index.join(F.broadcast(split), "leaf").withColumn("cp", own("c_parts")).withColumn("qp", each("q_parts")).select("vec_id", "vec", "leaf", *keys)
    right = asked.join(by_group, "grp").withColumn("qp", own("q_parts")).withColumn("cp", each("c_parts")).select("vec_id", "vec", "leaves", "most", *keys)

    def search(c_rows: pa.Table, q_rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if c_rows.num_rows and q_rows.num_rows:
            mat = lambda t: np.array(t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(t.num_rows, -1)
            all_c, all_q, c_leaf = mat(c_rows), mat(q_rows), c_rows["leaf"].to_numpy()
            c_ids, q_ids, q_most = (t[n].to_numpy() for t, n in ((c_rows, "vec_id"), (q_rows, "vec_id"), (q_rows, "most")))
            flat, off = lists(q_rows["leaves"].combine_chunks())
            place = np.repeat(np.arange(len(q_ids)), np.diff(off))
            for leaf in np.unique(c_leaf).tolist():
                here, ask = np.flatnonzero(c_leaf == leaf), place[flat == leaf]
                c, cid, q, qid, most = all_c[here], c_ids[here], all_q[ask], q_ids[ask], q_most[ask]
                for a in range(0, len(qid), 256):
                    d = distances(q[a : a + 256], c)
                    d[qid[a : a + 256][:, None] == cid[None, :]] = np.inf
                    near = min(k, len(cid)) - 1
                    kth = np.minimum(np.partition(d, near, axis=1)[:, near], most[a : a + 256])
                    # what rounding could bring among the k nearest is measured again, difference by difference
                    slack = 1e-9 * (1 + (q[a : a + 256] ** 2).sum(1) + (c * c).sum(1).max())
                    qi, ci = np.nonzero((d <= (kth + slack)[:, None]) & (d < np.inf))
                    s = np.concatenate([np.zeros(0)] + [np.sqrt(((q[a + qi[x : x + 8192]] - c[ci[x : x + 8192]]) ** 2).sum(1)) for x in range(0, len(qi), 8192)])
                    top = best_of(qi, s, cid[ci], k)
                    for o, v in zip(out, (ask[a + qi[top]], cid[ci[top]], s[top]), strict=True):
                        o.append(v)
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        if len(cols[0]):  # the best of all leaves of the group, by query row
            best = best_of(cols[0].astype(np.int64), cols[2], cols[1].astype(np.int64), k)
            cols = [q_ids[cols[0][best].astype(np.int64)], cols[1][best], cols[2][best]]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
