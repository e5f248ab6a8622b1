"""Substring removal over words: super-k-mer partitioning.

Windows of `length` words travel in super-k-mers (windows.py) to the bucket of
their minimiser. There all windows are sorted by a hash of their words, neighbours
with one hash are compared word by word, and of equal windows all but the earliest
(smaller id, then earlier start) are marked. The words that a marked window covers
are removed.

Cases: null text has no words; a text with fewer words than a window keeps all;
rows equal in id and text are not earlier than each other, so neither removes
the other; rows with the same id but other texts count as one document whose
windows are compared by start (so do rows without an id, which all have the
same); a null id is smaller than any other; an empty table gives an empty table; other columns are not read; texts of any length are
handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, spread, utf8, word_keys, word_spans
from .windows import NO_ID, ROW, Rule, Segments, bucket_count, covered, keyed, union_spans


def window_classes(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Class of each window (place of its first word among words): the same number where all words are the same, -1: no other is equal."""
    n = len(words) - length + 1
    run, span = mix(words), 1
    with np.errstate(over="ignore"):
        # a hash of `length` words by doubling; what decides is the comparison below
        while span * 2 <= length:
            run = mix(run[: len(run) - span] * np.uint64(0xD6E8FEB86659FD93) + run[span:])
            span *= 2
        rest = length - span
        if rest:
            run = mix(run[:n] * np.uint64(0xD6E8FEB86659FD93) + run[rest : rest + n])
    out, open_, made = np.full(len(at), -1), np.arange(len(at)), 0
    key = run[at]
    while len(open_):
        open_ = open_[np.argsort(key[open_], kind="stable")]
        own = key[open_]
        same = own[1:] == own[:-1]
        twin = np.append(same, False) | np.concatenate([[False], same])
        open_, own = open_[twin], own[twin]
        if not len(open_):
            break
        new = np.concatenate([[True], own[1:] != own[:-1]])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))
        x, y = at[open_], at[open_[lead]]
        equal = np.ones(len(open_), bool)
        for k in range(length):
            equal &= words[x + k] == words[y + k]
        group = np.cumsum(new) - 1
        several = np.bincount(group, equal)[group] > 1
        out[open_[equal & several]] = made + group[equal & several]
        made += int(group[-1]) + 1
        open_ = open_[~equal]  # other words with the same hash are classes of their own
    return out


def later_windows(rule: Rule):
    def judge(seg: Segments) -> tuple[np.ndarray, np.ndarray]:
        off = np.concatenate([[0], np.cumsum(seg.sizes, dtype=np.int64)])
        data = np.frombuffer(seg.text, np.uint8)
        s, e, first = word_spans(data, off)
        words = word_keys(data, s, e)
        owner, place = spread(seg.windows.astype(np.int64))
        if not len(owner):
            return owner, place
        group = window_classes(words, first[:-1][owner] + place, rule.length)
        order = np.flatnonzero(group >= 0)
        ids, start = seg.ids[owner[order]], seg.start[owner[order]] + place[order]
        o = np.lexsort((start, ids, group[order]))
        order, ids, start = order[o], ids[o], start[o]
        new = np.ones(len(order), bool)
        new[1:] = group[order[1:]] != group[order[:-1]]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        later = np.sort(order[(ids != ids[lead]) | (start != start[lead])])
        return owner[later], place[later]

    return judge


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 20, gram: int = 2, hot: float = 4.0) -> DataFrame:
    """doc_id, text (kept words joined by one blank), spans (removed ranges of words), n_words and n_removed of each row."""
    rows = keyed(df, id_col, text_col)
    rule = Rule(length, gram, words=True, first_stays=True, buckets=bucket_count(rows), hot=hot)
    spans = covered(rows, rule, later_windows(rule))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            s, e, first = word_spans(data, off)
            raw = data.tobytes()
            texts, ranges, removed = [], [], []
            for i, own in enumerate(batch.column(2).to_pylist()):
                lo, hi = int(first[i]), int(first[i + 1])
                keep = np.ones(hi - lo, bool)
                own = own or []
                a, b = union_spans(np.array([x["s"] for x in own], np.int64), np.array([x["e"] for x in own], np.int64))
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    keep[x:y] = False
                left = np.flatnonzero(keep) + lo
                texts.append(b" ".join([raw[p:q] for p, q in zip(s[left].tolist(), e[left].tolist(), strict=True)]))
                ranges.append([{"s": x, "e": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                removed.append(hi - lo - len(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(ranges, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(np.diff(first).astype(np.int64)), pa.array(removed, pa.int64())],
                ["doc_id", "text", "spans", "n_words", "n_removed"],
            )

    joined = rows.join(spans.hint("shuffle_hash"), ROW, "left").select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(apply, "doc_id long, text string, spans array<struct<s:int,e:int>>, n_words long, n_removed long")
