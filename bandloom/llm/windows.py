"""Packed windows in minimiser buckets: the exchange below substring removal.

A window is a fixed number of consecutive units (words or bytes) of one text.
Its minimiser is the smallest hash among the short grams in it. Consecutive
windows with the same minimiser form a segment, which travels once, as one
packed string, to the bucket of its minimiser; equal windows have equal
minimisers and meet in one bucket. Before that every task merges equal segments
of its own rows, so a passage that stands in many rows travels once per step of
a task; what the merging has settled goes along as bare ranges.

All segments of a step that go to one bucket make one row, a zstd-compressed
blob. A bucket's rows are the only thing that a reducing task holds at once.

A very common gram can be the minimiser of windows in a large share of all rows,
whose contexts differ, so that merging does not help. The bytes for each bucket
are therefore counted first, over all rows. Windows of a bucket with more than
`hot` times its share are dealt one by one, by a fingerprint of their whole
content, to a second range of buckets; two fingerprints (common.Prints, with
seeds of their own) stand for such a window, and two windows that differ share
both with a chance of less than 2**-100. Either way the bucket depends on the
window's content alone, so equal windows still meet.

A row is known by its id where ids are all different. Where some are not (null
ids, repeated rows) it is known by id and 120 bits of the SHA-256 of its text;
rows that are equal in both get the same spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Prints, byte_codes, cut, mix, prefix_hash, span_hash, spread, steps, utf8, word_spans

#: Stands for a null id inside; smaller than any id.
NO_ID = -(2**63)
_LOW = np.uint64((1 << 24) - 1)
#: Windows dealt one by one that are merged at a time.
HELD = 1 << 19


@dataclass
class Segments:
    """Entries of one bucket: row (id and digest), first window, windows, and the text where it is sent (size 0: a bare range)."""

    ids: np.ndarray
    one: np.ndarray
    two: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    sizes: np.ndarray
    flags: np.ndarray
    keys: np.ndarray
    text: bytes | bytearray

    _types = (("ids", "<i8"), ("one", "<i8"), ("two", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("sizes", "<i4"), ("flags", "u1"), ("keys", "<u8"))

    def pack(self) -> bytes:
        head = np.array([len(self.ids), len(self.text)], "<i8").tobytes()
        ids = self.ids.astype("<i8")
        delta = np.diff(ids, prepend=ids[:1] * 0)
        cols = [delta.tobytes()] + [getattr(self, n).astype(t).tobytes() for n, t in self._types[1:]]
        raw = b"".join([head, *cols, self.text])
        return np.int64(len(raw)).tobytes() + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)

    @classmethod
    def unpack(cls, blob: bytes) -> Segments:
        size = int(np.frombuffer(blob[:8], "<i8")[0])
        raw = pa.decompress(blob[8:], size, codec="zstd", asbytes=True)
        n, text = np.frombuffer(raw, "<i8", 2).tolist()
        at, out = 16, {}
        for name, t in cls._types:
            out[name] = np.frombuffer(raw, t, n, at)
            at += n * np.dtype(t).itemsize
        with np.errstate(over="ignore"):
            out["ids"] = np.cumsum(out["ids"], dtype=np.int64)
        return cls(**out, text=raw[at : at + text])

    @classmethod
    def join(cls, parts: list[Segments]) -> Segments:
        return cls(**{n: np.concatenate([getattr(p, n) for p in parts]) for n, _ in cls._types}, text=b"".join(p.text for p in parts))

    @classmethod
    def unpack_all(cls, blobs: pa.ChunkedArray) -> Segments:
        """The entries of all blobs; texts go to their place one blob at a time."""
        parts, text = [], bytearray()
        for blob in blobs:
            own = cls.unpack(blob.as_py())
            text += own.text
            parts.append({n: getattr(own, n).copy() for n, _ in cls._types})
        return cls(**{n: np.concatenate([p[n] for p in parts]) for n, _ in cls._types}, text=text)

    def at(self, rows: np.ndarray) -> Segments:
        """Some entries, with the whole text."""
        return Segments(**{n: getattr(self, n)[rows] for n, _ in self._types}, text=self.text)


@dataclass
class Rule:
    """What a window is: `length` units, minimisers over grams of `gram` units; words or bytes."""

    length: int
    gram: int
    words: bool
    #: True: of equal windows the earliest stays; False: all are repeated.
    first_stays: bool
    #: Whether segments bring their minimiser along.
    keyed: bool = False
    buckets: int = 64
    #: Buckets with more than `hot` times their share of bytes are spread window by window.
    hot: float = 4.0
    step_bytes: int = 8 << 20
    code: np.ndarray = field(default_factory=byte_codes)
    spread_over: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def window_prints(self, data: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of the content of the windows that begin at the given units."""
        out = []
        if self.words:
            s, e, _ = word_spans(data, off)
        for p in (Prints(2), Prints(3)):
            run = p.runs(p.words(data, s, e) if self.words else data.astype(np.uint64))
            parts = [at[x : x + HELD] for x in range(0, len(at), HELD)]
            out.append(np.concatenate([p.spans(run, x, x + self.length) for x in parts]))
        return out[0], out[1]

    def hashes(self, data: np.ndarray, off: np.ndarray):
        """Hash of each unit's gram, first unit of each row, and byte bounds of units in a text where one blank parts words."""
        if not self.words:
            run = prefix_hash(self.code[data])
            at = np.arange(max(0, len(data) - self.gram + 1))
            return span_hash(run, at, at + self.gram), off, data.tobytes(), None, None
        s, e, first = word_spans(data, off)
        run = prefix_hash(self.code[data])
        h = span_hash(run, s, e)
        n = len(s)
        g = h[: max(0, n - self.gram + 1)].copy()
        with np.errstate(over="ignore"):
            for k in range(1, self.gram):
                g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(g)]
        size = e - s
        begin = np.cumsum(size + 1) - (size + 1)
        clean = np.full(int((size + 1).sum()), 0x20, np.uint8)
        owner, place = spread(size)
        clean[begin[owner] + place] = data[s[owner] + place]
        return mix(g), first, clean.tobytes(), begin, begin + size

    def segments(self, data: np.ndarray, off: np.ndarray):
        """Row, first window (in the row), windows, minimiser and bytes of each segment, and the first unit of each row."""
        gram, first, raw, begin, end = self.hashes(data, off)
        units = np.diff(first)
        count = np.maximum(units - self.length + 1, 0)
        if not count.sum():
            return None
        width = self.length - self.gram + 1
        # smallest of `width` neighbours by doubling; the low bits hold the place, so the leftmost wins a tie
        key = (gram & ~_LOW) | (np.arange(len(gram), dtype=np.uint64) & _LOW)
        low, span = key, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        row, place = spread(count)
        at = first[:-1][row] + place
        least = low[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(at)))
        u = at[head]
        stop = u + n + self.length - 1
        lo, hi = (begin[u], end[stop - 1]) if self.words else (u, stop)
        return row[head], place[head], n, least[head] & ~_LOW, raw, lo, hi, first


def deal(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, one, two, text) to (bucket, blob): one row for each step and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(3))
            who = np.stack([batch.column(i).to_numpy() for i in range(3)])
            for a, b in steps(off, rule.step_bytes):
                yield from _deal_step(rule, data[off[a] : off[b]], off[a : b + 1] - off[a], who[:, a:b])

    return run


def loads(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (text) to (bucket, bytes): what each bucket would get, before equal segments are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            got = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in steps(off):
                part = rule.segments(data[off[a] : off[b]], off[a : b + 1] - off[a])
                if part is not None:
                    got[0].append((mix(part[3]) % np.uint64(rule.buckets)).astype(np.int64))
                    got[1].append(part[6] - part[5])
            which, at = np.unique(np.concatenate(got[0]), return_inverse=True)
            size = np.bincount(at, np.concatenate(got[1]), minlength=len(which)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(size)], ["bucket", "bytes"])

    return run


def hot_buckets(df: DataFrame, rule: Rule) -> np.ndarray:
    """Buckets with more than `hot` times the mean: at most buckets / hot of them."""
    sums = cut(df.select("text").mapInArrow(loads(rule), "bucket long, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes")))
    mean = F.broadcast(sums.agg((F.sum("bytes") / rule.buckets).alias("mean")))
    rows = sums.join(mean, F.col("bytes") > F.col("mean") * rule.hot).select("bucket").collect()
    return np.array(sorted(r["bucket"] for r in rows), np.int64)


def _deal_step(rule: Rule, data: np.ndarray, off: np.ndarray, who: np.ndarray) -> Iterator[pa.RecordBatch]:
    """who: id and digest (two numbers) of each row."""
    found, single, out, held = [], [], {}, 0
    for a, b in steps(off):
        own, lim = data[off[a] : off[b]], off[a : b + 1] - off[a]
        part = rule.segments(own, lim)
        if part is None:
            continue
        row, place, n, key, raw, lo, hi, first = part
        bucket = (mix(key) % np.uint64(rule.buckets)).astype(np.int64)
        hot = np.isin(bucket, rule.spread_over)
        if hot.any():
            seg, step = spread(n[hot])
            r, p = row[hot][seg], place[hot][seg] + step
            single.append((r + a, p, *rule.window_prints(own, lim, first[r] + p)))
            held += len(seg)
            if held > HELD:
                _deal_windows(rule, [np.concatenate(x) for x in zip(*single, strict=True)], who, out)
                single, held = [], 0
            row, place, n, key, bucket, lo, hi = (x[~hot] for x in (row, place, n, key, bucket, lo, hi))
        texts = [raw[s:e] for s, e in zip(lo.tolist(), hi.tolist(), strict=True)]
        found.append((row + a, place, n, key, bucket, texts))
    if found:
        _deal_segments(rule, found, who, out)
    if single:
        _deal_windows(rule, [np.concatenate(x) for x in zip(*single, strict=True)], who, out)
    if out:
        blobs = [Segments.join(parts).pack() for parts in out.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _chiefs(rule: Rule, same: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with the same content: which are sent (the earliest), and which have a twin in this step."""
    order = np.lexsort((place, ids, same))
    lead = np.ones(len(order), bool)
    lead[1:] = same[order][1:] != same[order][:-1]
    chief = order[lead]
    sends = np.zeros(len(same), bool)
    sends[chief] = True
    if rule.first_stays:  # rows that share id and place with the earliest are not later than it, and go along
        first_of = np.empty(int(same.max()) + 1, np.int64)
        first_of[same[chief]] = chief
        sends |= (ids == ids[first_of[same]]) & (place == place[first_of[same]])
    return sends, np.bincount(same)[same] > 1


def _by_bucket(bucket: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = order[np.argsort(bucket[order], kind="stable")]
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        yield int(bucket[order[s]]), order[s:e]


def _deal_segments(rule: Rule, found: list, who: np.ndarray, out: dict[int, list[Segments]]) -> None:
    row, place, n, key, bucket = (np.concatenate([f[i] for f in found]) for i in range(5))
    texts = [t for f in found for t in f[5]]
    if not texts:
        return
    number: dict[bytes, int] = {}
    same = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
    ids = who[0]
    sends, several = _chiefs(rule, same, ids[row], place)
    sizes = np.where(sends, np.fromiter(map(len, texts), np.int64, len(texts)), 0)
    for b, own in _by_bucket(bucket, np.lexsort((place, ids[row]))):
        text = b"".join([texts[i] for i in own.tolist() if sends[i]])
        keys = np.where(sends[own] & rule.keyed, key[own], np.uint64(0))
        out.setdefault(b, []).append(Segments(*who[:, row[own]], place[own], n[own], sizes[own], several[own], keys, text))


def _deal_windows(rule: Rule, single: list[np.ndarray], who: np.ndarray, out: dict[int, list[Segments]]) -> None:
    """Windows one by one: the first fingerprint is the key, the second the text of eight bytes."""
    row, place, one, two = single
    ids = who[0]
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(new) - 1
    sends, several = _chiefs(rule, same, ids[row], place)
    bucket = rule.buckets + (mix(one) % np.uint64(rule.buckets)).astype(np.int64)
    eight = lambda own: np.full(len(own), 8)
    for b, own in _by_bucket(bucket, np.flatnonzero(sends)):
        out.setdefault(b, []).append(Segments(*who[:, row[own]], place[own], np.ones(len(own), np.int64), eight(own), several[own], one[own], two[own].tobytes()))
    # what is settled here goes along as ranges
    done = np.flatnonzero(~sends)
    if len(done):
        done = done[np.lexsort((place[done], row[done]))]
        gap = np.ones(len(done), bool)
        gap[1:] = (row[done][1:] != row[done][:-1]) | (place[done][1:] != place[done][:-1] + 1)
        head = np.flatnonzero(gap)
        n, own = np.diff(np.append(head, len(done))), done[head]
        bare = (mix(ids[row[own]].astype(np.uint64)) % np.uint64(rule.buckets)).astype(np.int64)
        zero = np.zeros(len(own), np.int64)
        for b, at in _by_bucket(bare, np.arange(len(own))):
            o = own[at]
            out.setdefault(b, []).append(Segments(*who[:, row[o]], place[o], n[at], zero[at], zero[at], zero[at].astype(np.uint64), b""))


def judge_prints(rule: Rule, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows dealt one by one go."""
    two = np.frombuffer(seg.text, "<u8")
    order = np.lexsort((seg.start, seg.ids, two, seg.keys))
    k, t, i, s = seg.keys[order], two[order], seg.ids[order], seg.start[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)[group]
    gone = (i != i[lead]) | (s != s[lead]) if rule.first_stays else (np.bincount(group)[group] > 1) | (seg.flags[order] > 0)
    own = np.sort(order[gone])
    return own, np.zeros(len(own), np.int64)


def runs(segment: np.ndarray, window: np.ndarray, seg: Segments, length: int) -> tuple[np.ndarray, ...]:
    """Ranges of units [s, e) covered by the given windows (segment, window in it), sorted by segment and window."""
    if not len(segment):
        return seg.ids[:0], seg.one[:0], seg.two[:0], seg.start[:0], seg.start[:0]
    new = np.ones(len(segment), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(segment)) - 1
    own = segment[head]
    return seg.ids[own], seg.one[own], seg.two[own], seg.start[own] + window[head], seg.start[own] + window[tail] + length


Judge = Callable[[Segments], tuple[np.ndarray, np.ndarray]]


#: What a row is known by, beside its text.
ROW = ["id", "one", "two"]


def covered(df: DataFrame, rule: Rule, judge: Judge) -> DataFrame:
    """id, one, two and spans (sorted, disjoint ranges of units to remove) of the rows (id, one, two, text) that have any.

    judge gets the segments of one bucket that carry text and tells which windows go (segment, window).
    """

    rule = replace(rule, spread_over=hot_buckets(df, rule))

    def reduce(table: pa.Table) -> pa.Table:
        seg = Segments.unpack_all(table.column("blob"))
        bare = seg.at(np.flatnonzero(seg.sizes == 0))
        parts = [(bare.ids, bare.one, bare.two, bare.start, bare.start + bare.windows + rule.length - 1)]
        sent = np.flatnonzero(seg.sizes > 0)
        if len(sent):
            text = seg.at(sent)
            by_print = table.column("bucket")[0].as_py() >= rule.buckets
            parts.append(runs(*(judge_prints(rule, text) if by_print else judge(text)), text, rule.length))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        kinds = [*[pa.int64()] * 3, pa.int32(), pa.int32()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip([*ROW, "s", "e"], cols, kinds, strict=True)})

    dealt = df.select(*ROW, "text").mapInArrow(deal(rule), "bucket int, blob binary")
    marks = dealt.groupBy("bucket").applyInArrow(reduce, "id long, one long, two long, s int, e int")
    return marks.groupBy(*ROW).agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id (null as the smallest), one and two (a digest of the text where ids are not all different, else 0), text (null: empty), and more columns."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long")).alias("id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    if df.select(own).groupBy("id").count().where("count > 1").isEmpty():
        digest = [F.lit(0).cast("long")] * 2
    else:
        digest = [F.conv(F.substring(F.sha2(text.cast("binary"), 256), at, 15), 16, 10).cast("long") for at in (1, 16)]
    return df.select(own, digest[0].alias("one"), digest[1].alias("two"), text.alias("text"), *more)


def union_spans(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted maximal ranges of the union; touching ranges are joined."""
    if not len(s):
        return s, e
    o = np.argsort(s, kind="stable")
    s, e = s[o], np.maximum.accumulate(e[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    head = np.flatnonzero(new)
    return s[head], e[np.append(head[1:], len(s)) - 1]


def bucket_count(df: DataFrame, bytes_each: int = 2 << 20) -> int:
    """Buckets such that each gets about the segments of bytes_each bytes of text (one pass over the sizes)."""
    total = df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(16, -(-total // bytes_each))
