"""Substring removal over bytes: difference-cover blockwise suffix sorting.

Suffixes are compared to a depth of `length` bytes. They are dealt to buckets by
the minimiser of their first `length` bytes (windows.py), so equal ones meet,
and the text of a bucket is sorted one block of minimiser groups at a time:

1. the cover sample, the places whose residue modulo v is in a difference
   cover, gets ranks to depths v, 2v and 4v, once for the block's text;
2. suffixes are dealt to suffix buckets by their first eight bytes, and one run
   of suffix buckets of bounded size is sorted at a time, by three-way
   partitioning. For any two residues there is a shift below v that takes both
   suffixes to places of the sample, whose ranks settle long ties; the bytes
   before the shift, and a tail of less than v bytes, are compared as they are.

Memory is the text, two to three numbers for each of its places in the sample
(one in seven), and a few numbers for each suffix of the run. A bucket's text is
bounded by the split of hot buckets in windows.py.

Groups of suffixes whose minimiser stands in one place of the corpus are left
out before sorting: nothing can equal them. Equal suffixes to the full depth
are repeated strings, and every byte that one covers is removed.

Cases: null text is empty; matches never cross texts; a text shorter than
`length` keeps all; rows equal in id and text are two texts, which repeat each
other; a null id is an id like any other; an empty table gives an empty table;
other columns are not read; texts of any length are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import eight_bytes, spread, utf8
from .windows import NO_ID, ROW, Rule, Segments, bucket_count, covered, keyed, union_spans

#: A perfect difference cover (every residue but 0 is one difference of two members).
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: Bytes of text of a block (a group with one minimiser stays whole), and suffixes that are sorted at once.
BLOCK = 2 << 20
SUFFIXES = 1 << 18


def shifts() -> np.ndarray:
    """For residues a, b: the least k with a + k and b + k both in the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    r = np.arange(PERIOD)
    for k in reversed(range(PERIOD)):
        a = inside[(r + k) % PERIOD]
        out[np.ix_(a, a)] = k
    assert out.min() >= 0
    return out


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Order-preserving ranks of tuples of numbers."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        own = key[order]
        new[1:] |= own[1:] != own[:-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


class CoverSample:
    """Ranks of the places of a text whose residue modulo PERIOD is in the cover, to depths PERIOD * 2**j up to `length`."""

    def __init__(self, text: np.ndarray, word: np.ndarray, length: int):
        v = PERIOD
        self.number = np.full(v, -1)
        self.number[list(COVER)] = np.arange(len(COVER))
        rows = -(-len(text) // v)
        at = (np.arange(rows)[:, None] * v + np.array(COVER)).reshape(-1)
        at = at[at < len(text)]
        rank = np.zeros(len(at), np.int32)
        for j in [*range(0, v - 8, 8), v - 8]:
            # places near the end look at bytes beyond it; no window that is asked for does
            rank = _rank(rank, word[np.minimum(at + j, len(text))].astype(np.uint64))
        self.reach = 1
        while self.reach * 2 * v <= length - v + 1:
            ahead = np.zeros_like(rank)
            step = self.reach * len(COVER)
            ahead[: max(0, len(rank) - step)] = rank[step:]
            rank = _rank(rank, ahead)
            self.reach *= 2
        self.rank = rank

    def of(self, place: np.ndarray) -> np.ndarray:
        return self.rank[place // PERIOD * len(COVER) + self.number[place % PERIOD]]


def _sign(word: np.ndarray, x: np.ndarray, p: np.ndarray, verdict: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Settle by the PERIOD bytes from x and p on; gives what is still open."""
    for j in [*range(0, PERIOD - 8, 8), PERIOD - 8]:
        if not len(open_):
            break
        a, b = word[x[open_] + j].astype(np.uint64), word[p[open_] + j].astype(np.uint64)
        verdict[open_] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
        open_ = open_[a == b]
    return open_


def equal_suffixes(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Class of each suffix (start in `at`, at least `length` bytes of its own text follow): equal to `length` bytes have the same class >= 0; -1: no other is equal."""
    v = PERIOD
    if length < 2 * v:
        raise ValueError(f"the depth must be at least {2 * v}")
    out = np.full(len(at), -1, np.int64)
    word = eight_bytes(text, ">u8")
    first = word[at].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    first = first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]]) if len(order) else np.zeros(0, bool)
    label = np.cumsum(new) - 1
    several = (np.bincount(label) > 1)[label] if len(label) else new
    order, label = order[several], label[several]
    if not len(order):
        return out
    sample, shift, made, a = CoverSample(text, word, length), shifts(), 0, 0
    ends = np.flatnonzero(np.diff(label, append=-1)) + 1
    while a < len(order):
        # whole suffix buckets, up to SUFFIXES of them together
        b = int(ends[max(np.searchsorted(ends, a + SUFFIXES, "right") - 1, np.searchsorted(ends, a, "right"))])
        made = _sorted_run(word, sample, shift, at, order[a:b], label[a:b], length, out, made)
        a = b
    return out


def _sorted_run(word: np.ndarray, sample: CoverSample, shift: np.ndarray, at: np.ndarray, order: np.ndarray, label: np.ndarray, length: int, out: np.ndarray, made: int) -> int:
    """Three-way partitioning of suffixes (order: their numbers, label: their suffix buckets) until all are settled."""
    v = PERIOD
    while len(order):
        _, begin, label, size = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
        x, p = at[order], at[order[begin + size // 2]][label]
        verdict = np.zeros(len(x), np.int8)
        open_ = _sign(word, x, p, verdict, np.arange(len(x)))
        k = shift[x[open_] % v, p[open_] % v]
        for last in (False, True):  # the ranks from the shift on, and those that end with the last whole period
            to = k + ((length - k) // v - sample.reach) * v if last else k
            own = sample.of(x[open_] + to) - sample.of(p[open_] + to)
            verdict[open_] = np.sign(own)
            open_, k = open_[own == 0], k[own == 0]
        _sign(word, x + (length - v), p + (length - v), verdict, open_)
        same = verdict == 0
        done = same & (np.bincount(label, same)[label] > 1)
        out[order[done]] = made + label[done]
        made += len(size)
        rest = ~same
        order, label = order[rest], label[rest] * 2 + (verdict[rest] > 0)
        turn = np.argsort(label, kind="stable")
        order, label = order[turn], label[turn]
        keep = (np.bincount(label) > 1)[label] if len(label) else label.astype(bool)
        order, label = order[keep], label[keep]
    return made


def repeated_windows(rule: Rule):
    length = rule.length

    def judge(seg: Segments) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(seg.text, np.uint8)
        begin = np.cumsum(seg.sizes, dtype=np.int64) - seg.sizes
        # blocks of whole minimiser groups, without groups of one segment
        _, group, members = np.unique(seg.keys, return_inverse=True, return_counts=True)
        flagged = seg.flags > 0
        use = np.flatnonzero(members[group] > 1)
        use = use[np.argsort(group[use], kind="stable")]
        out_seg, out_win = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sized = np.cumsum(seg.sizes[use], dtype=np.int64)
        turn = np.flatnonzero(np.diff(group[use], append=-1))  # last segment of each group
        a = 0
        while a < len(use):
            limit = (sized[a - 1] if a else 0) + BLOCK
            fits = turn[(turn >= a) & (sized[turn] <= limit)]
            b = int(fits[-1] if len(fits) else turn[turn >= a][0]) + 1
            own = use[a:b]
            a = b
            text = np.concatenate([data[x:y] for x, y in zip(begin[own].tolist(), (begin[own] + seg.sizes[own]).tolist(), strict=True)])
            base = np.cumsum(seg.sizes[own], dtype=np.int64) - seg.sizes[own]
            ws, wp = spread(seg.windows[own].astype(np.int64))
            hit = equal_suffixes(text, base[ws] + wp, length) >= 0
            out_seg.append(own[ws[hit]])
            out_win.append(wp[hit])
        # segments that were equal in one task are repeated whatever else is found
        own = np.flatnonzero(flagged)
        ws, wp = spread(seg.windows[own].astype(np.int64))
        out_seg.append(own[ws])
        out_win.append(wp)
        s, w = np.concatenate(out_seg), np.concatenate(out_win)
        code = np.unique(s << 32 | w)
        return code >> 32, code & 0xFFFFFFFF

    return judge


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 24, hot: float = 4.0, as_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, bytes (what is left), spans (maximal removed ranges of bytes), n_bytes and n_removed of each row.

    as_text: a column text instead of bytes, without characters that a cut has
    halved. carry: further columns to pass along under their names.
    """
    passed = [F.col(c).alias(f"_bl_{i}") for i, c in enumerate(carry)]
    types = [f.dataType.simpleString() for f in df.select(*carry).schema.fields] if carry else []
    rows = keyed(df, id_col, text_col, *passed)
    rule = Rule(length, gram, words=False, first_stays=False, keyed=True, buckets=bucket_count(rows), hot=hot)
    spans = covered(rows, rule, repeated_windows(rule))
    names = ["doc_id", "text" if as_text else "bytes", "spans", "n_bytes", "n_removed", *carry]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw, lim = data.tobytes(), off.tolist()
            left, ranges, removed = [], [], []
            for i, own in enumerate(batch.column(2).to_pylist()):
                text, own = raw[lim[i] : lim[i + 1]], own or []
                a, b = union_spans(np.array([x["s"] for x in own], np.int64), np.array([x["e"] for x in own], np.int64))
                a, b = a.tolist(), b.tolist()
                left.append(b"".join([text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)]))
                ranges.append([{"s": x, "e": y} for x, y in zip(a, b, strict=True)])
                removed.append(len(text) - len(left[-1]))
            kept = pa.array([x.decode(errors="ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), kept, pa.array(ranges, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(np.diff(off)), pa.array(removed, pa.int64()), *batch.columns[3:]],
                names,
            )

    joined = rows.join(spans.hint("shuffle_hash"), ROW, "left").select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "text", "spans", *[f"_bl_{i}" for i in range(len(carry))])
    kinds = ["long", "string" if as_text else "binary", "array<struct<s:int,e:int>>", "long", "long", *types]
    return joined.mapInArrow(apply, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True)))
