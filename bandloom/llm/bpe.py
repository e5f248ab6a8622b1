"""Byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression. Each code point has a class
from an array; classes with lookahead folded in drive a small automaton, whose
states at all places come from an associative scan: the text is cut into rows
of equal length, every row's transition function (a map from state to state) is
composed column by column for all rows at once, the rows' functions are
composed by doubling, and a last pass replays the columns from known states and
reads off the boundaries. The slices then feed a cached pair merging. The byte
offset at which each token ends is kept beside the ids; decoding copies the bytes
of all tokens of a step from one flat table to those offsets at once.

A step holds at most STEP_BYTES of text (or one longer text). encode() and
decode() are operators of their own; round_trip() does both in one pass, so that
ids need not go through the JVM in between.

Cases: null text counts as empty (no ids, empty bytes); repeated rows give
repeated rows; an empty table gives an empty table; other columns are not read;
a text of any length is handled whole; bytes that are no UTF-8 are replaced by
U+FFFD first, as a reader of text would do.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, packed_lists, steps, utf8

# Classes: other, letter, number, blank before a visible character, other white
# space before one, white space before white space or the end, apostrophe that
# can start a contraction of two or of three characters.
OTHER, LETTER, NUMBER, BLANK, SPACE, RUN, SHORT, LONG = range(8)
# States: at a boundary, within letters, numbers, others, after a blank that the
# next token takes, within white space, one or two characters of a contraction to go.
FRESH, IN_L, IN_N, IN_O, GLUE, IN_W, ONE, TWO = range(8)
COLUMNS = 128
FAR = 1 << 40


def _every() -> np.ndarray:
    """Every code point that a text can hold."""
    return np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])


def _matched(library: str, kind: str) -> np.ndarray | None:
    """Code points of a general category as the Unicode tables of the named library have them."""
    every = _every().astype("<u4").tobytes().decode("utf-32-le")
    try:
        if library == "tiktoken":
            import tiktoken

            probe = tiktoken.Encoding("probe", pat_str=rf"\p{{{kind}}}+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            return np.frombuffer(probe.decode(probe.encode_ordinary(every)).encode("utf-32-le"), np.uint32)
        if library == "tokenizers":
            from tokenizers import Regex, pre_tokenizers

            parts = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed").pre_tokenize_str(every)
            keep = np.ones(len(every), bool)
            for _, (a, b) in parts:
                keep[a:b] = False
            return _every()[keep]
    except ImportError:
        pass
    return None


@lru_cache(4)
def code_classes(library: str = "tiktoken") -> np.ndarray:
    """The class of each code point by its general category; white space by the property White_Space.

    Libraries differ in the version of Unicode they follow, so the categories
    are taken from the one whose ids are to be matched, and from Python's own
    tables where that library is missing.
    """
    out = np.zeros(0x110000, np.uint8)
    for kind, k in (("L", LETTER), ("N", NUMBER)):
        found = _matched(library, kind)
        out[[c for c in _every().tolist() if unicodedata.category(chr(c))[0] == kind] if found is None else found] = k
    white = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = SPACE
    out[0x20] = BLANK
    return out


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary flag at class * 8 + state; classes from 8 on start a text."""
    to, cut = np.zeros(128, np.intp), np.zeros(128, bool)
    for c in range(8):
        for s in range(8):
            if s in (ONE, TWO):
                t, b = (FRESH, False) if s == ONE else (ONE, False)
            elif c in (LETTER, NUMBER, OTHER):
                t = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}[c]
                b = s not in (t, GLUE)
            elif c in (SHORT, LONG):
                t, b = (IN_O, False) if s in (IN_O, GLUE) else (ONE if c == SHORT else TWO, True)
            elif c == RUN:
                t, b = IN_W, s != IN_W
            else:
                t, b = GLUE if c == BLANK else FRESH, True
            to[c * 8 + s], cut[c * 8 + s] = t, b
    for c in range(8):
        to[(8 + c) * 8 : (9 + c) * 8], cut[(8 + c) * 8 : (9 + c) * 8] = to[c * 8 + FRESH], True
    return to, cut


def boundaries(code: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Flags of the code points that start a pre-token; first: flags of those that start a text."""
    n = len(code)
    if n == 0:
        return np.zeros(0, bool)
    base = classes[code]
    white = (base == BLANK) | (base == SPACE)
    visible_next = np.zeros(n, bool)
    visible_next[:-1] = ~white[1:] & ~first[1:]
    kind = base.copy()
    kind[white & ~visible_next] = RUN
    quote = np.flatnonzero(code == 0x27)
    if len(quote):
        ahead = lambda k: np.where((quote + k < n) & ~first[np.minimum(quote + k, n - 1)], code[np.minimum(quote + k, n - 1)], 0)
        one, two = ahead(1), ahead(2)
        two = np.where(one == 0, 0, two)
        kind[quote[np.isin(one, [ord(x) for x in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kind[quote[pair]] = LONG
    kind[first] += 8
    to, cut = automaton()
    rows = -(-n // COLUMNS)
    grid = np.full(rows * COLUMNS, RUN, np.intp)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(rows, COLUMNS).T) * 8
    # 1. each row's function: where each of the eight states leads
    fun = np.repeat(np.arange(8)[:, None], rows, 1)
    for col in grid:
        fun = to.take(fun + col)
    # 2. composition of the rows' functions by doubling
    step = 1
    while step < rows:
        after = fun.copy()
        after[:, step:] = np.take_along_axis(fun[:, step:], fun[:, :-step], 0)
        fun = after
        step *= 2
    state = np.empty(rows, np.intp)
    state[0], state[1:] = FRESH, fun[FRESH, :-1]
    # 3. replay from known states
    out = np.empty((COLUMNS, rows), bool)
    for j, col in enumerate(grid):
        at = state + col
        out[j] = cut[at]
        state = to.take(at)
    return out.T.reshape(-1)[:n]


def rank_table(spec: bytes) -> dict[bytes, int]:
    """Bytes and ranks of a tiktoken rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line)}


class Encoder(dict):
    """Ids of pre-tokens as packed 32-bit numbers; made when first asked for, at most `cap` kept."""

    def __init__(self, ranks: dict[bytes, int], cap: int = 120_000):
        super().__init__()
        self.ranks, self.cap = ranks, cap

    def __missing__(self, token: bytes) -> bytes:
        ids = np.array(self.merge(token), "<u4").tobytes()
        if len(self) >= self.cap:
            self.clear()
        if len(token) <= 256:
            self[token] = ids
        return ids

    def merge(self, token: bytes) -> list[int]:
        """Lowest rank first, the leftmost of equals, until no pair has a rank."""
        ranks = self.ranks
        if token in ranks:
            return [ranks[token]]
        n = len(token)
        if n <= 48:
            edge, get = [*range(n + 1)], ranks.get
            pair = [get(token[i : i + 2], FAR) for i in range(n - 1)]
            while pair and (low := min(pair)) < FAR:
                i = pair.index(low)
                del edge[i + 1], pair[i]
                if i < len(pair):
                    pair[i] = get(token[edge[i] : edge[i + 2]], FAR)
                if i:
                    pair[i - 1] = get(token[edge[i - 1] : edge[i + 1]], FAR)
            return [ranks[token[a:b]] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        begin, end = list(range(n)), [*range(1, n + 1)]
        nxt, prev = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or not alive[i] or end[j] != stop:
                continue
            alive[j] = False
            end[i], nxt[i] = stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(token[begin[i] : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get(token[begin[p := prev[i]] : stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[begin[i] : end[i]]])
            i = nxt[i]
        return out


def pre_tokens(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> Iterator[tuple[list[bytes], list[int]]]:
    """For steps of rows: their pre-tokens, and the first pre-token of each row (and the end)."""
    for a, b in steps(off):
        raw = data[off[a] : off[b]].tobytes()
        lim = off[a : b + 1] - off[a]
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            texts = [raw[s:e].decode(errors="replace").encode() for s, e in zip(lim[:-1], lim[1:], strict=True)]
            raw, lim = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            text = raw.decode()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        begins = lim[:-1][lim[1:] > lim[:-1]]
        first = np.zeros(len(code), bool)
        first[np.searchsorted(place, begins)] = True
        start = place[boundaries(code, first, classes)]
        edge = [*start.tolist(), len(raw)]
        yield [raw[s:e] for s, e in zip(edge[:-1], edge[1:], strict=True)], np.searchsorted(start, lim).tolist()


class TokenBytes:
    """The bytes of all tokens in one flat table, by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
        self.size[list(ranks.values())] = [len(k) for k in ranks]
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size
        self.flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset at which each token ends, if all stand one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id that the ranks lack")
        return np.cumsum(self.size[ids], dtype=np.int64)

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, each put where it ends."""
        size = self.size[ids]
        return self.flat[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def encoded(data: np.ndarray, off: np.ndarray, encoder: Encoder, table: TokenBytes, classes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For steps of rows a to b: a, b, the ids, the first id of each row (and the end), and the offsets at which tokens end in the step."""
    a = 0
    for tokens, of in pre_tokens(data, off, classes):
        packed = list(map(encoder.__getitem__, tokens))
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        count = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4, out=count[1:])
        del tokens, packed
        b = a + len(of) - 1
        yield a, b, ids, count[of], table.ends(ids)
        a = b


def _from_zero(ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Offsets counted from the start of each row."""
    before = np.concatenate([[0], ends])[first]
    return (ends - np.repeat(before[:-1], np.diff(first))).astype(np.int32)


def _text(data: np.ndarray, lim: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a flat byte array."""
    return pa.Array.from_buffers(kind, len(lim) - 1, [None, pa.py_buffer(lim.astype(np.int32)), pa.py_buffer(data)])


def encode(df: DataFrame, spec: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and ends (the byte offset at which each token ends) of each row.

    spec is the content of a tiktoken rank file (a fixed, small size), sent as a
    broadcast variable. No shuffle takes place.
    """
    shared = df.sparkSession.sparkContext.broadcast((spec, code_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, classes = rank_table(shared.value[0]), shared.value[1]
        encoder, table = Encoder(ranks), TokenBytes(ranks)
        for batch in batches:
            for a, b, ids, first, ends in encoded(*utf8(batch.column(1)), encoder, table, classes):
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), packed_lists(pa.array(ids), n), packed_lists(pa.array(_from_zero(ends, first)), n)], ["doc_id", "ids", "ends"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, ends array<int>")


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def decode(df: DataFrame, spec: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of each row of ids. Null ids count as none; an id that the ranks lack is an error."""
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(rank_table(shared.value))
        for batch in batches:
            ids, off = _lists(batch.column(1))
            for a, b in steps(off * 4):
                own = ids[off[a] : off[b]]
                ends = table.ends(own)
                lim = np.concatenate([[0], ends])[off[a : b + 1] - off[a]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _text(table.joined(own, ends), lim, pa.binary())], ["doc_id", "bytes"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, bytes binary")


def round_trip(df: DataFrame, spec: bytes, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that is decoded from them; digests: SHA-256 of the ids (little-endian, 32 bits) and of the decoded bytes instead."""
    shared = df.sparkSession.sparkContext.broadcast((spec, code_classes()))
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "text"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, classes = rank_table(shared.value[0]), shared.value[1]
        encoder, table = Encoder(ranks), TokenBytes(ranks)
        sha = lambda data, lim: pa.array([hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(lim[:-1].tolist(), lim[1:].tolist(), strict=True)], pa.string())
        for batch in batches:
            for a, b, ids, first, ends in encoded(*utf8(batch.column(1)), encoder, table, classes):
                back, lim = table.joined(ids, ends), np.concatenate([[0], ends])[first]
                n = np.diff(first)
                if digests:
                    made = [sha(memoryview(ids.astype("<u4")).cast("B") if len(ids) else b"", first * 4), sha(memoryview(back), lim)]
                else:
                    made = [packed_lists(pa.array(ids), n), _text(back, lim, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *made], names)

    kinds = ["long", "long", *(["string", "string"] if digests else ["array<int>", "string"])]
    return id_text(df, id_col, text_col).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
