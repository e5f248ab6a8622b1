"""Vectors packed in blocks, and joins of blocks.

Both searches compare a stated set of queries with all rows. Rows and queries
are packed into blocks of bounded size, and blocks meet by an equi-join on a
group number, so that a task holds one block of each at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (array of double) of the rows that have an id and a vector without null or non-finite components."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list column without nulls."""
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows of each dimension in a batch (vec_id, vec)."""
    ids = batch.column(0).to_numpy()
    values, off = lists(batch.column(1))
    dims = np.diff(off)
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield ids[rows], values[off[rows][:, None] + np.arange(d)]


def pack(rows: int, change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, vec) to blocks of at most `rows` vectors of one dimension: (dim, ids, body), body float64, vectors as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: dict[int, list] = {}

        def flush(d: int, least: int) -> Iterator[pa.RecordBatch]:
            ids, mats = (np.concatenate(x) for x in zip(*wait.pop(d), strict=True))
            a = 0
            while len(ids) - a >= least:
                own = mats[a : a + rows]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids[a : a + rows].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(own.T).tobytes()], pa.binary())], ["dim", "ids", "body"])
                a += rows
            if a < len(ids):
                wait[d] = [(ids[a:], mats[a:])]

        for batch in batches:
            for ids, mat in by_dimension(batch):
                d = mat.shape[1]
                wait.setdefault(d, []).append((ids, change(mat)))
                if sum(len(x[0]) for x in wait[d]) >= rows:
                    yield from flush(d, rows)
        for d in list(wait):
            yield from flush(d, 1)

    return run


BLOCK = "dim int, ids binary, body binary"


def unblock(ids: bytes, body: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (as columns) of a block."""
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(body, np.float64).reshape(dim, len(i))


def best_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores of each query, ties to smaller ids, in that order."""
    o = np.lexsort((ids, score, query))
    q = query[o]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    return o[np.arange(len(q)) - begin < k]
