"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors are stored vertically (one row per dimension). For a block of queries
and a block of candidates the products are accumulated dimension block by
dimension block; the mass that remains in later dimensions bounds what a
candidate can still gain or lose (Cauchy-Schwarz), and candidates whose upper
bound is below the k-th best lower bound are compacted away. The k-th best
result of earlier blocks is carried into later ones as a first bound.

Components are integers, floor(scale * x), and sums of products below 2**53 are
exact in double precision. Where they can be larger, the bounds also leave room
for rounding, and the scores of what survives are computed with Python integers
and compared as such; only a returned score ends at the limits of 64 bits.

Cases: vectors that are null, empty or hold null or non-finite components, and
rows without an id, take no part; rows that share the query's id count as the
query's own row; rows equal in id and vector are candidates of their own but one
query; rows that share an id and differ are one query with several vectors, each
of which can bring a candidate into the list;
vectors of another dimension than the query's are no candidates; ties go to the
smaller vec_id; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import BLOCK, best_of, clean, pack, unblock

DIMS = 16
EXACT = float(1 << 53)


def branch_and_bound(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int, floor: np.ndarray, rounding: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, score) of a superset of each query's k best that reach its floor.

    q, c: dimensions x vectors, integers in float64. floor: the score to reach by query (-inf: any).
    rounding: the error of a sum of products in relation to the product of the two lengths.
    """
    dim, nq, nc = len(q), q.shape[1], c.shape[1]
    edges = [*range(0, dim, DIMS), dim]
    mass = lambda m: np.sqrt(np.concatenate([np.cumsum((m * m)[::-1], 0)[::-1], np.zeros((1, m.shape[1]))]))
    mq, mc = mass(q), mass(c)
    room = 2 * rounding  # of a bound and of the floor that it is held against
    acc = np.zeros((nq, nc))
    acc[qid[:, None] == cid[None, :]] = -np.inf
    floor = floor.copy()
    qi = ci = None  # survivors, once they are few
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if qi is None:
            acc += q[a:b].T @ c[a:b]
            slack = np.outer(mq[b], mc[b]) * (1 + 1e-9) + (1e-6 if b < dim else 0) + room * np.outer(mq[0], mc[0])
            if nc >= k:
                low = np.partition(acc - slack, nc - k, axis=1)[:, nc - k]
                floor = np.maximum(floor, low)
            alive = (acc + slack >= floor[:, None]) & (acc > -np.inf)
            if b == dim or alive.mean() < 0.25:
                qi, ci = np.nonzero(alive)
                acc = acc[qi, ci]
        else:
            acc = acc + np.einsum("ij,ij->j", q[a:b][:, qi], c[a:b][:, ci])
            slack = mq[b][qi] * mc[b][ci] * (1 + 1e-9) + (1e-6 if b < dim else 0) + room * mq[0][qi] * mc[0][ci]
            top = best_of(qi, slack - acc, ci, k)
            n = np.bincount(qi[top], minlength=nq)
            kth = np.full(nq, -np.inf)
            last = np.flatnonzero(np.append(qi[top][1:] != qi[top][:-1], True)) if len(top) else top
            kth[qi[top][last]] = (acc - slack)[top][last]
            floor = np.maximum(floor, np.where(n >= k, kth, -np.inf))
            alive = acc + slack >= floor[qi]
            qi, ci, acc = qi[alive], ci[alive], acc[alive]
    return qi, ci, acc


def _scores(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact scores: int64 where all products are below 2**53, Python integers elsewhere."""
    dim = len(q)
    if np.abs(q).max() * np.abs(c).max() * dim < EXACT:
        qi, ci, s = branch_and_bound(q, qid, c, cid, k, floor.astype(np.float64))
        return qi, ci, s.astype(np.int64)
    # scaled by powers of two, so that nothing overflows; floors of other blocks are left out
    unit = lambda m: m * 2.0 ** -float(np.frexp(np.abs(m).max())[1])
    qi, ci, _ = branch_and_bound(unit(q), qid, unit(c), cid, k, np.full(len(qid), -np.inf), (dim + 2) * 2.0**-52)
    whole = lambda m, own: {j: [int(x) for x in m[:, j]] for j in np.unique(own).tolist()}
    one, two = whole(q, qi), whole(c, ci)
    return qi, ci, np.array([sum(x * y for x, y in zip(one[i], two[j], strict=True)) for i, j in zip(qi.tolist(), ci.tolist(), strict=True)] or [0], object)[: len(qi)]


def _best(qi: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each query, ties to smaller ids."""
    if s.dtype != object:
        return best_of(qi, ~s, ids, k)
    rank = {x: r for r, x in enumerate(sorted(set(s.tolist()), reverse=True))}
    return best_of(qi, np.array([rank[x] for x in s.tolist()], np.int64), ids, k)


def search_pairs(k: int, held: int = 16):
    """Joined blocks (q_dim, q_ids, q_body, ids, body) to (query_id, vec_id, score): k best of each query by run of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list] = {}

        def give(key: bytes) -> pa.RecordBatch:
            qid, qi, ids, s, _ = best.pop(key)
            s = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in s.tolist()], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(qid[qi]), pa.array(ids), pa.array(s)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                dim, key, q_body, c_ids, body = (batch.column(i)[r].as_py() for i in range(5))
                qid, q = unblock(key, q_body, dim)
                cid, c = unblock(c_ids, body, dim)
                if key not in best:
                    if len(best) >= held:
                        yield give(next(iter(best)))
                    best[key] = [qid, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(len(qid), -np.inf)]
                _, oqi, oid, os_, floor = best[key]
                qi, ci, s = _scores(q, qid, c, cid, k, floor)
                qi, ids, s = np.concatenate([oqi, qi]), np.concatenate([oid, cid[ci]]), np.concatenate([os_, s])
                top = _best(qi, s, ids, k)
                qi, ids, s = qi[top], ids[top], s[top]
                floor = np.full(len(qid), -np.inf)  # rounded down a little where it is not exact
                n = np.bincount(qi, minlength=len(qid))
                last = np.cumsum(n) - 1
                full = n >= k
                low = s[last[full]].astype(np.float64)
                floor[full] = np.where(np.abs(low) < EXACT, low, low - np.abs(low) * 2.0**-50)
                best[key] = [qid, qi, ids, s, floor]
        for key in list(best):
            yield give(key)

    return run


def exact_top_k(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, query_block: int = 512, row_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest integer inner products of each row whose id is divisible by `every`, against all other rows."""
    rows = clean(df, id_col, vec_col)
    change = lambda m: np.floor(m * float(scale))
    # about 16 blocks of rows in a group, which all blocks of queries meet one after the other
    groups = max(8, -(-rows.count() // (16 * row_block)))
    blocks = rows.mapInArrow(pack(row_block, change), BLOCK).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"]).mapInArrow(pack(query_block, change), BLOCK)
    asked = asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("body").alias("q_body"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    pairs = blocks.join(asked, (asked["g"] == blocks["g"]) & (F.col("dim") == F.col("q_dim"))).select("q_dim", "q_ids", "q_body", "ids", "body")
    found = pairs.mapInArrow(search_pairs(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
