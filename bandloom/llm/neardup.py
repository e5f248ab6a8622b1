"""Near-duplicate classes by MinHash with tensored banding.

Every document's set of word shingles gets two small collections of hashes, A
and B, of `side` entries each; an entry combines `depth` minima. A table's key
is a pair (A_i, B_j), so side * side tables with 2 * depth minima per key cost
only 2 * side * depth minima. Rows are dealt by A_i and carry all B_j, so the
pairs are formed where they are compared and each document is sent `side`
times. Two sets of similarity s share a key unless no A_i or no B_j agrees: with
side 12 and depth 3 a pair at 0.8 is missed with probability 0.0004.

Documents with equal sets are one class from the start. Links between classes
are found in two steps.

1. Families. In a group (one key) two members are near if set sizes and
   signatures leave a link possible (five standard deviations below the
   threshold). Each task gives only as many pairs as it takes to connect the
   documents that chains of near members connect, never all pairs of a group;
   the connected components of these pairs are the families. Whatever shares a
   key and could be linked is in one family.
2. Links. The members of a family are compared on their full sets of shingle
   fingerprints, taken from the whole texts, unless links found before connect
   them already. A family of up to a block (by documents and by shingles) meets
   in one task. In a larger one the pairs that made the family are confirmed
   first, each star of them in parts of bounded size; then all that these links
   do not put into the family's largest component meet, in blocks, one another
   and the blocks of that component. So a large group of near copies costs a
   task for each block of it and not for each two blocks.

Shingles are compared by fingerprints modulo a prime (common.Prints): two
different ones agree with a chance of about 2**-58, and the confirmation of links
uses other fingerprints than the search. Components are found by alternating
stars on pairs, in the cluster; a star's centre is never the key of more rows
than AQE can split.

An entry A_i that more than max(5000, a hundred-thousandth of all) rows share is
hot (at most 100,000 of them). Its rows are dealt by (A_i, B_j) and in blocks of
about 2000, of which every two meet in a task of their own.

Cases: null text and text without words have an empty set, linked with nothing;
with fewer words than a shingle the whole sequence is the one shingle; rows that
share an id are one document in links, each with its own set; a null id is an id
of its own, smaller than all; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import Prints, cut, mix, spread, steps, utf8, word_spans
from .windows import NO_ID


@dataclass
class Scheme:
    words: int = 5
    percent: int = 80
    side: int = 12
    depth: int = 3
    seed: int = 11

    @property
    def minima(self) -> int:
        return 2 * self.side * self.depth

    def least_equal(self) -> int:
        """Equal minima below which a pair at the threshold is five standard deviations off."""
        s = self.percent / 100
        return max(0, int(np.floor(self.minima * s - 5 * np.sqrt(self.minima * s * (1 - s)))))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int, prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each row, one row after the other, and their numbers."""
    data = _LOWER[data]
    s, e, first = word_spans(data, off)
    run = prints.runs(prints.words(data, s, e))
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    row, place = spread(count)
    at = first[:-1][row] + place
    hashes = prints.spans(run, at, at + np.minimum(words, n)[row])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[keep], np.bincount(row[keep], minlength=len(n))


def signatures(scheme: Scheme):
    """(id, text) to (id, n, h, a, b, sig): set size, hash of the set, the two collections, and a byte of each minimum."""
    prints = Prints(scheme.seed)
    rng = np.random.default_rng(scheme.seed)
    factor = rng.integers(0, 2**63, scheme.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, scheme.minima, dtype=np.uint64)
    prime = np.uint64(0xD6E8FEB86659FD93)

    def step(data: np.ndarray, off: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        hashes, n = shingle_sets(data, off, scheme.words, prints)
        some = np.flatnonzero(n)
        begin = (np.cumsum(n) - n)[some]
        low = np.zeros((len(n), scheme.minima), np.uint64)
        whole = np.zeros((len(n), 2), np.uint64)
        with np.errstate(over="ignore"):
            if len(some):
                for f in range(scheme.minima):
                    low[some, f] = np.minimum.reduceat(hashes * factor[f] + shift[f], begin)
                for c in range(2):  # sums of scrambled members: a hash of the set
                    whole[some, c] = np.add.reduceat(mix(hashes ^ shift[c]), begin)
            low = mix(low)
            parts = low.reshape(len(n), 2 * scheme.side, scheme.depth)
            keys = parts[:, :, 0].copy()
            for d in range(1, scheme.depth):
                keys = keys * prime + parts[:, :, d]
            keys = mix(keys + np.arange(2 * scheme.side, dtype=np.uint64))
        fixed = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
        a = np.ascontiguousarray(keys[:, : scheme.side])
        b = (keys[:, scheme.side :] >> np.uint64(32)).astype("<u4")
        return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), fixed(whole), fixed(a), fixed(b), fixed((low & np.uint64(255)).astype(np.uint8))], ["id", "n", "h", "a", "b", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in steps(off):
                yield step(data[off[a] : off[b]], off[a : b + 1] - off[a], batch.column(0).slice(a, b - a))

    return run


def _columns(table, names: tuple[str, ...], types: tuple[str, ...]) -> list[np.ndarray]:
    """Binary columns of equal width as matrices."""
    out = []
    for name, t in zip(names, types, strict=True):
        raw = b"".join(table[name].to_pylist())
        out.append(np.frombuffer(raw, t).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1), t))
    return out


def entry_counts(scheme: Scheme):
    """Rows (a) to (key, n): how often each entry A_i stands in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(_columns(pa.table(batch), ("a",), ("<u8",))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def hot_entries(chosen: DataFrame, scheme: Scheme, rows: int, least: int = 5000) -> np.ndarray:
    """Entries A_i that very many rows share, sorted."""
    counts = chosen.select("a").mapInArrow(entry_counts(scheme), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    most = max(least, rows * scheme.side // 100_000)
    found = counts.where(F.col("n") > most).select("key").collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


@dataclass
class Rows:
    """Documents of a task: id, set size, signature."""

    ids: np.ndarray
    n: np.ndarray
    sig: np.ndarray

    def possible(self, scheme: Scheme, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether size and signature leave a link possible, pair by pair (p and q broadcast)."""
        small, large = np.minimum(self.n[p], self.n[q]), np.maximum(self.n[p], self.n[q])
        return (100 * small >= scheme.percent * large) & ((self.sig[p] == self.sig[q]).sum(-1) >= scheme.least_equal())


class Forest:
    """Union-find; keeps the pairs that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def tie(self, a: int, b: int) -> None:
        """Join without keeping the pair."""
        x, y = self.root(a), self.root(b)
        self.up[max(x, y)] = min(x, y)

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.kept.append((min(a, b), max(a, b)))

    def table(self) -> pa.Table:
        a, b = zip(*self.kept, strict=True) if self.kept else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def joined_groups(scheme: Scheme, rows: Rows, order: np.ndarray, lead: np.ndarray, forest: Forest, step: int = 1 << 15) -> None:
    """Join the members of each group (positions in order, of the group's first) that chains of possible links connect."""
    far = np.flatnonzero(lead != np.arange(len(lead)))
    near = np.zeros(len(far), bool)
    for z in range(0, len(far), step):
        part = far[z : z + step]
        near[z : z + step] = rows.possible(scheme, order[lead[part]], order[part])
    for a, b in np.unique(np.stack([rows.ids[order[lead[far[near]]]], rows.ids[order[far[near]]]]), axis=1).T.tolist():
        forest.join(a, b)
    # who is far from the first of the group may be near to another member
    failed = far[~near]
    begin = np.flatnonzero(lead == np.arange(len(lead)))
    end = np.append(begin[1:], len(lead))
    own_failed = np.zeros(len(lead), bool)
    own_failed[failed] = True
    for g in np.unique(np.searchsorted(begin, lead[failed])).tolist():
        s, e = begin[g], end[g]
        if e - s < 3:
            continue
        member, bad = order[s:e], own_failed[s:e]
        left, front = member[bad], member[1:][~bad[1:]]
        while len(left):
            if not len(front):
                front, left = left[:1], left[1:]
            found = np.full(len(left), -1)
            for z in range(0, len(front), 256):
                block = front[z : z + 256]
                open_ = np.flatnonzero(found < 0)
                for y in range(0, len(open_), 256):
                    some = open_[y : y + 256]
                    ok = rows.possible(scheme, block[:, None], left[some][None, :])
                    hit = ok.any(0)
                    found[some[hit]] = block[ok.argmax(0)[hit]]
            hit = found >= 0
            for a, b in zip(rows.ids[found[hit]].tolist(), rows.ids[left[hit]].tolist(), strict=True):
                forest.join(a, b)
            front, left = left[hit], left[~hit]


def _hot_keys(scheme: Scheme, a: np.ndarray, b: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each (A_i, B_j) whose A_i is hot."""
    row, i = np.nonzero(np.isin(a, hot))
    with np.errstate(over="ignore"):
        key = mix(a[row, i][:, None] * np.uint64(0x9E3779B97F4A7C15) + (b[row].astype(np.uint64) << np.uint64(8)) + np.arange(scheme.side, dtype=np.uint64))
    return np.repeat(row, scheme.side), key.reshape(-1)


def hot_pairs(chosen: DataFrame, scheme: Scheme, hot: np.ndarray, block: int = 2000) -> DataFrame:
    """Pairs (a, b) that connect the documents of hot entries, by pair key and by blocks of about `block` rows."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            row, key = _hot_keys(scheme, *_columns(table, ("a", "b"), ("<u8", "<u4")), hot)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[table[c].combine_chunks().take(pa.array(row)) for c in ("id", "n", "sig")]], ["key", "id", "n", "sig"])

    def met(table: pa.Table) -> pa.Table:
        rows = Rows(table["id"].to_numpy(), table["n"].to_numpy(), _columns(table, ("sig",), ("u1",))[0])
        forest = Forest()
        if len(rows.ids) > 1:
            joined_groups(scheme, rows, np.argsort(rows.ids, kind="stable"), np.zeros(len(rows.ids), np.int64), forest)
        return forest.table()

    entries = chosen.select("id", "a", "b", "n", "sig").mapInArrow(keys, "key long, id long, n long, sig binary")
    sizes = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    parts = entries.join(sizes, "key").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")})
    return pairs.groupBy("key", "lo", "hi").applyInArrow(met, PAIR)


def deal(scheme: Scheme, buckets: int, hot: np.ndarray):
    """Rows to (bucket, blob): entries A_i that are not hot, with id, set size, B and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            a, b, sig = _columns(table, ("a", "b", "sig"), ("<u8", "<u4", "u1"))
            ids, n = table["id"].to_numpy(), table["n"].to_numpy()
            row, i = np.repeat(np.arange(len(ids)), scheme.side), np.tile(np.arange(scheme.side), len(ids))
            key = a[row, i]
            if len(hot):
                cold = ~np.isin(key, hot)
                row, key = row[cold], key[cold]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            out = [], []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                own = order[s:e]
                out[0].append(int(bucket[own[0]]))
                out[1].append(b"".join([np.int64(len(own)).tobytes(), key[own].tobytes(), *[np.ascontiguousarray(x[row[own]]).tobytes() for x in (ids, n, b, sig)]]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "blob"])

    return run


def _entries(scheme: Scheme, blobs: list[bytes]) -> list[np.ndarray]:
    shapes = [("<u8", 1), ("<i8", 1), ("<i8", 1), ("<u4", scheme.side), ("u1", scheme.minima)]
    parts: list[list] = [[] for _ in shapes]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, "<i8", 1)[0]), 8
        for p, (t, width) in zip(parts, shapes, strict=True):
            p.append(np.frombuffer(blob, t, n * width, at).reshape(n, width))
            at += n * width * np.dtype(t).itemsize
    out = [np.concatenate(p) for p in parts]
    return [x[:, 0] if x.shape[1] == 1 else x for x in out]


def _groups(key: np.ndarray, b: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each j: entries in groups of equal (A_i, B_j) by id, and the group's first position for each."""
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    use = np.flatnonzero(n[inverse] > 1)
    if not len(use):
        return
    part = inverse[use].astype(np.int64) << 32
    for j in range(b.shape[1]):
        pair = part | b[use, j].astype(np.int64)
        order = np.lexsort((ids[use], pair))
        p = pair[order]
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        yield use[order], np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))


def bucket_pairs(scheme: Scheme):
    """Pairs (a, b) that connect the documents of a bucket which chains of possible links within groups connect: fewer than documents."""

    def run(table: pa.Table) -> pa.Table:
        key, ids, n, b, sig = _entries(scheme, table["blob"].to_pylist())
        rows, forest = Rows(ids, n, sig), Forest()
        for order, lead in _groups(key, b, ids):
            joined_groups(scheme, rows, order, lead, forest)
        return forest.table()

    return run


PAIR = "a long, b long"


def _sets(table: pa.Table, scheme: Scheme, prints: Prints) -> list[np.ndarray]:
    """Shingle sets of the whole texts."""
    data, off = utf8(table["text"].combine_chunks())
    sets: list[np.ndarray] = []
    for s, e in steps(off):
        h, n = shingle_sets(data[off[s] : off[e]], off[s : e + 1] - off[s], scheme.words, prints)
        sets += np.split(h, np.cumsum(n)[:-1])
    return sets


def block_links(scheme: Scheme):
    """(label, lo, hi) and rows (side, id, comp, text) to links that connect: of two blocks (sides), or of one (lo = hi)."""
    prints = Prints(scheme.seed + 1)

    def met(key: tuple, table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        same = key[1].as_py() == key[2].as_py()
        sets = _sets(table, scheme, prints)
        size = np.array([len(x) for x in sets])
        # shingles that stand in several sets, as bits; for very long texts the sets themselves are intersected
        _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(n > 1) - 1
        width = -(-int((n > 1).sum()) // 8)
        bits = np.zeros((len(sets), width), np.uint8) if len(sets) * width <= 1 << 25 else None
        if bits is not None:
            row = np.repeat(np.arange(len(sets)), size)
            keep = n[at] > 1
            row, col = row[keep], place[at[keep]]
            np.bitwise_or.at(bits, (row, col >> 3), (1 << (col & 7)).astype(np.uint8))
        forest = Forest()
        for a, b in zip(ids.tolist(), table["comp"].to_pylist(), strict=True):
            forest.tie(a, b)
        order = np.argsort(ids, kind="stable")
        for i, p in enumerate(order.tolist()):
            other = order[i + 1 :]
            if not same:
                other = other[side[other] != side[p]]
            other = other[100 * np.minimum(size[other], size[p]) >= scheme.percent * np.maximum(size[other], size[p])]
            own = forest.root(int(ids[p]))
            other = np.array([q for q in other.tolist() if forest.root(int(ids[q])) != own], np.int64)
            if not len(other):
                continue
            if bits is not None:
                common = np.bitwise_count(bits[other] & bits[p]).sum(1, dtype=np.int64)
            else:
                common = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for q in other.tolist()])
            linked = (100 * common >= scheme.percent * (size[other] + size[p] - common)) & (size[other] > 0)
            for q in other[linked].tolist():
                forest.join(int(ids[p]), int(ids[q]))
        return forest.table()

    return met


def star_links(scheme: Scheme):
    """(centre, part) and rows (id, text) to links of the centre with the others."""
    prints = Prints(scheme.seed + 1)

    def met(key: tuple, table: pa.Table) -> pa.Table:
        ids, sets, centre = table["id"].to_numpy(), _sets(table, scheme, prints), key[0].as_py()
        forest = Forest()
        for p in np.flatnonzero(ids == centre).tolist():
            for q in np.flatnonzero(ids != centre).tolist():
                x, y = len(sets[p]), len(sets[q])
                if 100 * min(x, y) < scheme.percent * max(x, y) or not y:
                    continue
                common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * common >= scheme.percent * (x + y - common):
                    forest.join(centre, int(ids[q]))
        return forest.table()

    return met


def confirmed(near: DataFrame, weights: DataFrame, rows: DataFrame, scheme: Scheme, block: int = 512, shingles: int = 400_000) -> DataFrame:
    """Links (a, b) within the families that pairs `near` make, on the full shingle sets of the whole texts (rows: id, text).

    weights: id and n, its shingles. A block has about `block` documents or `shingles` shingles at most (or one document).
    """
    by_block = lambda count, total: F.greatest(F.ceil(count / block), F.ceil(total / shingles)).cast("int")
    placed = components(near).join(weights, "id")
    sizes = placed.groupBy("label").agg(by_block(F.count("*"), F.sum("n")).alias("blocks"))
    placed = cut(placed.join(sizes, "label"))
    large = placed.where("blocks > 1").select("id", "label", "n")
    some = not large.isEmpty()
    if some:  # several joins need the texts of the families, so these are taken out of all texts once
        rows = stored(rows.join(placed.select("id"), "id", "left_semi"))
    texts = lambda members: rows.join(members.hint("shuffle_hash"), "id")
    small = placed.where("blocks = 1").select("id", "label", F.lit(0).alias("side"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.col("id").alias("comp"))
    links = texts(small).groupBy("label", "lo", "hi").applyInArrow(block_links(scheme), PAIR)
    if not some:
        return links
    # the pairs that made a large family, a star at a time
    pairs = near.join(large.select(F.col("id").alias("b"), "n"), "b")
    parts = pairs.groupBy("a").agg(by_block(F.count("*"), F.sum("n")).alias("parts"))
    far = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"))
    stars = far.unionByName(far.select("a", "part").distinct().withColumn("id", F.col("a")))
    linked = cut(texts(stars).groupBy("a", "part").applyInArrow(star_links(scheme), PAIR).distinct())
    # all but the largest component of a family meets everything, in blocks
    comp = components(linked).withColumnRenamed("label", "comp")
    large = large.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mains = large.groupBy("label", "comp").agg(F.count("*").alias("m")).groupBy("label").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("main"))
    large = cut(large.join(mains, "label").withColumn("rest", (F.col("comp") != F.col("main")).cast("int")).drop("main"))
    rest = large.groupBy("label").agg(*[by_block(F.sum(F.when(F.col("rest") == r, 1).otherwise(0)), F.sum(F.when(F.col("rest") == r, F.col("n")).otherwise(0))).alias(c) for r, c in ((1, "r_blocks"), (0, "m_blocks"))])
    own = large.join(rest.where("r_blocks > 0"), "label")
    place = F.xxhash64("id")
    side = F.when(F.col("rest") == 1, F.pmod(place, F.col("r_blocks"))).otherwise(F.col("r_blocks") + F.pmod(place, F.col("m_blocks"))).cast("int")
    last = F.when(F.col("rest") == 1, F.col("r_blocks") + F.col("m_blocks") - 1).otherwise(F.col("r_blocks") - 1)
    own = own.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    own = own.select("id", "label", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "comp")
    more = texts(own).groupBy("label", "lo", "hi").applyInArrow(block_links(scheme), PAIR)
    return links.unionByName(linked).unionByName(more)


def components(links: DataFrame) -> DataFrame:
    """id and label (smallest id reachable) of every id in links (a, b), by alternating large and small stars.

    Edges (u, v) go from the larger to the smaller id. The least neighbour of each
    u is aggregated before the shuffle and written, so both sides of the large join
    are plain exchanges, which AQE splits where one id is the key of many edges. It
    ends when every u has one edge, and no v has any: then all edges are stars.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: an edge's larger end goes to the smallest neighbour of the other end
        low = cut(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("n")))
        large = cut(edges.join(low.select("w", "m"), F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")))
        if (low.agg(F.max("n")).first()[0] or 0) <= 1 and large.where("moved").isEmpty():
            break
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(low.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(small).distinct())
    return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id").union(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None, entries_each: int = 40_000, hot_from: int = 5000, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept of each row."""
    scheme = scheme or Scheme()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long")).alias("id"), text.alias("text"))
    sigs = cut(rows.mapInArrow(signatures(scheme), "id long, n long, h binary, a binary, b binary, sig binary"))
    classes = sigs.where("n > 0").groupBy("h").agg(F.min("id").alias("rep"))
    chosen = cut(sigs.where("n > 0").join(classes.withColumnRenamed("h", "ch"), (F.col("h") == F.col("ch")) & (F.col("id") == F.col("rep")), "left_semi").dropDuplicates(["id", "h"]))
    total = chosen.count()
    buckets = max(16, total * scheme.side // entries_each)
    hot = hot_entries(chosen, scheme, total, hot_from)
    near = chosen.select("id", "n", "a", "b", "sig").mapInArrow(deal(scheme, buckets, hot), "bucket int, blob binary").groupBy("bucket").applyInArrow(bucket_pairs(scheme), PAIR)
    if len(hot):
        near = near.unionByName(hot_pairs(chosen, scheme, hot))
    weights = chosen.groupBy("id").agg(F.sum("n").alias("n"))
    label = components(confirmed(cut(near.distinct()), weights, rows, scheme, block))
    named = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("h", F.coalesce("label", "rep").alias("label"))
    out = sigs.select("id", "n", "h").join(named, "h", "left").withColumn("label", F.coalesce("label", "id"))
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("label").alias("component_id"), (F.col("id") == F.col("label")).alias("kept"))
