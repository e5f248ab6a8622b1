"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens by the boundary scan of bpe.py; pre-tokens not seen before are held together
as one ragged array of symbols. In each round every sequence finds its own
lowest-rank adjacent pair and merges all places of that pair at once; sequences
without a mergeable pair leave with their number of symbols. Counts of
pre-tokens are kept in a bounded cache.

A round costs the length of every sequence that is left, and a sequence takes about
as many rounds as it has distinct merges. Beyond LONG bytes that would be quadratic,
so such pre-tokens are merged one by one with a heap of their ranked pairs, which
gives the same symbols.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated rows; an empty table gives an empty table; a null id stays null; only
the id and the text are read, so other columns can have any name; one very long
pre-token is a sequence like any other.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import code_classes, pre_tokens
from .common import id_text, utf8

NONE = np.int64(1 << 40)
#: Bytes of a pre-token from which it is merged by a heap.
LONG = 4096
#: Pre-tokens in the cache before it is emptied.
CACHE = 400_000


class MergeTable:
    """Symbols and ranked pairs of a byte-level BPE in the tokenizers JSON format."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        vocab = j["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.special = sorted((t["content"] for t in j["added_tokens"]), key=len, reverse=True)
        # Bytes that can't be printed stand for code points from 256 on, in order of the bytes.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte = np.array([vocab[char[b]] for b in range(256)], np.int64)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        self.pairs: dict[int, tuple[int, int]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def count_long(self, sequence: bytes) -> int:
        """Symbols left of one sequence: always the lowest rank, the leftmost of equals, from a heap."""
        if not self.pairs:
            self.pairs = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.made[self.rank].tolist(), strict=True), strict=True))
        sym = self.byte[np.frombuffer(sequence, np.uint8)]
        rank = self.ranks(sym[:-1], sym[1:])
        heap = [(r, i, a, b) for r, i, a, b in zip(rank.tolist(), range(len(rank)), sym[:-1].tolist(), sym[1:].tolist(), strict=True) if r < NONE]
        heapq.heapify(heap)
        n, left, sym = len(sym), len(sym), array("q", sym.tolist())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

        def offer(i: int, j: int) -> None:
            if found := self.pairs.get(sym[i] << 32 | sym[j]):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i], left = self.pairs[a << 32 | b][1], -1, after[j], left - 1
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return left

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each sequence after all merges."""
        out = np.zeros(len(sequences), np.int64)
        for i, s in enumerate(sequences):
            if len(s) > LONG:
                out[i] = self.count_long(s)
        sequences = [s if len(s) <= LONG else b"" for s in sequences]
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        sym = self.byte[np.frombuffer(b"".join(sequences), np.uint8)]
        alive = np.flatnonzero(sizes > 0)
        sizes = sizes[alive]
        while len(alive):
            start = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(alive)), sizes)
            rank = np.full(len(sym), NONE)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[start + sizes - 1] = NONE  # no pair crosses sequences
            least = np.minimum.reduceat(rank, start)
            hit = np.flatnonzero((rank == least[owner]) & (rank < NONE))
            if len(hit):
                # of overlapping places (aaa) every second one counts, from the left
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
                first = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
                sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            live = least < NONE
            sizes = sizes - np.bincount(owner[hit], minlength=len(alive))
            out[alive[~live]] = sizes[~live]
            keep &= live[owner]
            sym, alive, sizes = sym[keep], alive[live], sizes[live]
        return out


class Counter:
    """Token counts of rows of UTF-8, with the counts of pre-tokens seen before."""

    def __init__(self, spec: bytes, classes: np.ndarray):
        self.table, self.classes = MergeTable(spec), classes
        self.special = [s.encode() for s in self.table.special]
        self.split = re.compile(b"|".join(map(re.escape, self.special))) if self.special else None
        self.known: dict[bytes, int] = {}

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A special string is one token, and no pre-token crosses it: texts without such strings, the row of each, specials by row."""
        found = np.zeros(len(off) - 1, np.int64)
        raw = data.tobytes() if self.split is not None else b""
        if self.split is None or not any(s in raw for s in self.special):
            return data, off, np.arange(len(off) - 1), found
        parts, row = [], []
        for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            own = self.split.split(raw[s:e])
            found[i] = len(own) - 1
            parts += own
            row += [i] * len(own)
        sizes = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), np.array(row, np.int64), found

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        data, lim, row, out = self.pieces(data, off)
        at = 0
        for tokens, of in pre_tokens(data, lim, self.classes):
            known = self.known
            fresh = [t for t in set(tokens) if t not in known]
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = list(set(tokens))
            if fresh:
                known.update(zip(fresh, self.table.count(fresh).tolist(), strict=True))
            run = np.zeros(len(tokens) + 1, np.int64)
            np.cumsum(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), out=run[1:])
            n = run[of[1:]] - run[of[:-1]]
            np.add.at(out, row[at : at + len(n)], n)
            at += len(n)
        return out


def token_counts(df: DataFrame, spec: bytes, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    spec is the content of a tokenizers JSON file (a fixed, small size), which
    goes to the executors as a broadcast variable. No shuffle takes place.
    """
    shared = df.sparkSession.sparkContext.broadcast((spec, code_classes("tokenizers")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            data, off = utf8(batch.column(1))
            n = counter.counts(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
