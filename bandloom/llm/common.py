"""Helpers shared by the training-data operators.

Everything here works on Arrow record batches, so that whole batches of text
are handled as one byte buffer with offsets and never as a Python list of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Bytes of text handled by one numpy step; a longer text makes a step of its own.
STEP_BYTES = 1 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


#: Write a result to the shared checkpoint folder, so that lost executors cost no recomputation.
cut = written


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names; other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary column; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if big else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def steps(off: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together; a longer row stands alone."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("i", _INV)):
                steps_ = np.full(size, base, _U64)
                steps_[0] = 1
                _powers[key] = np.cumprod(steps_, dtype=_U64)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
        return h ^ (h >> _U64(31))


def byte_codes(fold: bool = False, seed: int = 1) -> np.ndarray:
    """A random odd 64-bit code for each byte; fold: A-Z count as a-z."""
    code = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
    if fold:
        code[65:91] = code[97:123]
    return code


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums (n + 1) of 64-bit codes; see span_hash.

    Modulo a power of two there are long texts that differ and have one hash
    whatever the base. So this serves where a coincidence does no harm (to choose
    minimisers, buckets and features); what decides on equality is Prints.
    """
    p, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, _U64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * p[: len(codes)], out=out[1:])
    return out


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans [start, end); equal contents and lengths have equal hashes wherever they stand."""
    _, inv = powers(len(run))
    with np.errstate(over="ignore"):
        return mix((run[end] - run[start]) * inv[start] + mix((end - start).astype(_U64) + _U64(0x5851F42D4C957F2D)))


#: The Mersenne prime that fingerprints are taken modulo.
PRIME = (1 << 61) - 1
_P, _M30, _M31 = _U64(PRIME), _U64((1 << 30) - 1), _U64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U64(61))
    return np.where(x >= _P, x - _P, x)


def mul_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, both below it; the product is put together from halves of 30 and 31 bits."""
    ah, al, bh, bl = a >> _U64(31), a & _M31, b >> _U64(31), b & _M31
    mid = ah * bl + al * bh
    return _reduced(((ah * bh) << _U64(1)) + (mid >> _U64(30)) + ((mid & _M30) << _U64(31)) + al * bl)


_tables: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo PRIME; the longest table of a base is kept."""
    p = _tables.get(base, np.ones(1, _U64))
    if len(p) < n:
        while len(p) < n:
            p = np.concatenate([p, mul_mod(p, _U64(pow(base, len(p), PRIME)))])
        _tables[base] = p
    return p[:n]


class Prints:
    """Fingerprints below 2**61 - 1: polynomials modulo that prime at places drawn by the seed.

    For two different contents of n units that were not chosen by the seed, the
    chance of one fingerprint is at most (n + 2) / 2**61; seeds are independent.
    """

    def __init__(self, seed: int):
        self.seed = seed
        self.inner, self.outer = np.random.default_rng([seed, 61]).integers(1 << 32, PRIME, 2, dtype=np.uint64).tolist()

    def runs(self, units: np.ndarray, base: int | None = None) -> np.ndarray:
        """Running polynomial sums (n + 1) of units below PRIME."""
        x = mul_mod(units, _powers_of(base or self.outer, len(units)))
        out = np.zeros(len(units) + 1, _U64)
        high = _reduced(np.cumsum(x >> _U64(31)))
        out[1:] = _reduced(((high << _U64(31)) & _P) + (high >> _U64(30)) + _reduced(np.cumsum(x & _M31)))
        return out

    def spans(self, run: np.ndarray, start: np.ndarray, end: np.ndarray, base: int | None = None) -> np.ndarray:
        """Fingerprints of spans [start, end) of running sums."""
        base = base or self.outer
        inverse = _powers_of(pow(base, -1, PRIME), len(run))
        own = mul_mod(_reduced(run[end] + (_P - run[start])), inverse[start])
        # the length is a coefficient of its own, below all units
        return _reduced(mul_mod(own, _U64(base)) + (end - start).astype(_U64) + _U64(1))

    def words(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Fingerprints of words (byte ranges): blocks of seven bytes as coefficients, and the length; very long words go through a keyed digest."""
        size = e - s
        out = size.astype(_U64) + _U64(1)
        word = eight_bytes(data)
        at, left = np.arange(len(s)), size
        long = size > 56
        if long.any():
            key = self.inner.to_bytes(8, "little")
            for i in np.flatnonzero(long).tolist():
                raw = hashlib.blake2b(data[s[i] : e[i]].tobytes(), digest_size=8, key=key).digest()
                out[i] = int.from_bytes(raw, "little") % PRIME
            at, left = at[~long], left[~long]
        block = 0
        while len(at):
            keep = np.minimum(left, 7).astype(_U64) * _U64(8)
            unit = word[s[at] + 7 * block] & ((_U64(1) << keep) - _U64(1))
            out[at] = _reduced(mul_mod(out[at], np.full(len(at), self.inner, _U64)) + unit)
            more = left > 7
            at, left, block = at[more], left[more] - 7, block + 1
        return out


def eight_bytes(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as one number (zeros beyond the end), as a view of the padded bytes."""
    return np.ndarray((len(data) + 1,), kind, data.tobytes() + bytes(8), strides=(1,))


def word_keys(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Numbers that are equal exactly where words of this call are equal: up to seven bytes and their number, else the turn of the word."""
    size = e - s
    short = size <= 7
    bits = np.minimum(size, 7).astype(_U64) * _U64(8)
    out = (eight_bytes(data)[s] & ((_U64(1) << bits) - _U64(1))) | (size.astype(_U64) << _U64(56))
    rest = np.flatnonzero(~short)
    if len(rest):
        raw, turn = data.tobytes(), {}
        own = (turn.setdefault(raw[a:b], len(turn)) for a, b in zip(s[rest].tolist(), e[rest].tolist(), strict=True))
        out[rest] = np.fromiter(own, np.uint64, len(rest)) | (_U64(1) << _U64(63))
    return out


#: Bytes that separate words: space and 09 to 0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each row (n + 1); words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)  # a row begins (or the data end) here
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def packed_lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged groups of the given sizes: the group of each member, and its place in the group."""
    total = int(counts.sum())
    group = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return group, np.arange(total) - begin[group]
