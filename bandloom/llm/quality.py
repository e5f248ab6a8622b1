"""Quality classifier by co-training.

Two views of a document: its text content (shape measures and the words it
holds) and its page metadata (language, source, stated length in steps of a
quarter of an octave, and pairs of these). A view is a pair of logistic models,
one for low quality and one for toxicity. Both views start on the labelled rows;
in each round a view scores unlabelled documents and gives the other view the
most confident ones of each class, by rank: of N unlabelled documents and a class
with the prior p, the `share` * p * N documents with the most evidence for the
class (all that tie with the last of them in a step of 1/256; none whose evidence
speaks against it). The share grows with each round. What a view teaches weighs as
much as it was found to know: 2 * AUC - 1 on held-out labels (LEAST at least), so a
view that can't tell the classes apart is heard, but hardly counts. At last each
view's scores are calibrated on cross-fitted scores of the labelled rows (Platt
scaling), the calibrated log-odds (less the prior, which both hold) are added with
weights fitted on the same scores, the cut that parts the classes best is found on
them, and all documents are scored.

Labelled rows are a bounded sample on the driver (max_labelled of each
class: neither, low quality, toxic, both; chosen by a hash of the id). Unlabelled documents stay on the executors, and all
of them take part: each round scores every one, words are chosen on the counts of
all pseudo-labelled documents, and models that start from a fit on the labelled
rows follow gradients summed up over all of them. Pseudo-labelled documents of a
class weigh one each, but together no more than the labelled ones of the class
(both times what the teaching view is worth). All documents are scored, whole, by
the executors.

Cases: null text counts as empty; null or unknown language and source are values
of their own; a null or missing length is taken as 0; repeated rows get equal
scores; labels with a null, and labels of unknown documents, are not used; a
document with several labels counts once, with the worst of each kind; with no labels of a class its
model scores 0 for all (nothing is rejected on it); an empty table gives an empty
table; columns other than those named are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_codes, cut, prefix_hash, span_hash, steps, utf8, word_spans

BITS = 18
#: Shape measures of a text.
SHAPES = 12
META_BITS = 12
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TRIM = ~_LETTER
_TRIM[[*range(48, 58)]] = False


def _ragged_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return run[first[1:]] - run[first[:-1]]


def text_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape measures (rows x SHAPES), and the distinct hashed words of each row with their first positions (n + 1)."""
    n = len(off) - 1
    s, e, first = word_spans(data, off)
    words = np.maximum(np.diff(first), 1)
    size = np.maximum(np.diff(off), 1)
    code = byte_codes(fold=True)
    share = lambda mask: _ragged_sum(mask, off) / size
    upper = (data >= 65) & (data <= 90)
    letter = _LETTER[data]
    digit = (data >= 48) & (data <= 57)
    # words without marks at either end, in lower case: from the next to the last byte that is none
    place = np.arange(len(data))
    after = np.minimum.accumulate(np.where(_TRIM[data], len(data), place)[::-1])[::-1]
    upto = np.maximum.accumulate(np.where(_TRIM[data], -1, place))
    lo = np.minimum(after[s], e)
    hi = np.maximum(upto[e - 1] + 1, lo)
    run = prefix_hash(code[data])
    h = (span_hash(run, lo, hi) >> np.uint64(64 - BITS)).astype(np.int64)
    whole = span_hash(run, s, e)
    row = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(s), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (row[1:] == row[:-1])
    pure = (hi - lo) != (e - s)
    blank = np.flatnonzero(hi == lo)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    keep = np.ones(len(hs), bool)
    keep[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    distinct = np.bincount(rs[keep], minlength=n)
    line = np.zeros(len(data), bool)
    line[data == 10] = True
    shape = np.stack(
        [
            share(upper),
            share(digit),
            share(~letter & ~digit & (data > 32)),
            share(line),
            (_ragged_sum(e - s, first) / words) / 10,
            distinct / words,
            _ragged_sum(same, first) / words,
            _ragged_sum(pure, first) / words,
            np.bincount(row[blank], minlength=n) / words,
            np.log1p(np.diff(first)) / 10,
            share(data == 0x7C) * 10,
            share(data >= 128),
        ],
        axis=1,
    )
    return shape, hs[keep], np.concatenate([[0], np.cumsum(distinct)])


def meta_features(lang: list, source: list, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two measures of the length, and hashed language, source, length step and their pairs."""
    hashed = lambda t: zlib.crc32(t.encode()) % (1 << META_BITS)
    known: dict[tuple, list[int]] = {}

    def members(a: str, b: str, c: int) -> list[int]:
        if (a, b, c) not in known:
            known[a, b, c] = sorted({hashed(x) for x in (f"l{a}", f"s{b}", f"n{c}", f"p{a}|{b}", f"m{a}|{c // 4}", f"o{b}|{c // 4}")})
        return known[a, b, c]

    step = np.floor(4 * np.log2(np.maximum(length, 0) + 1)).astype(np.int64).tolist()
    ids = [members(a, b, c) for a, b, c in zip(lang, source, step, strict=True)]
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.array([y for x in ids for y in x], np.int64)
    size = np.log1p(np.maximum(length, 0)) / 10
    return np.stack([size, size * size], axis=1).reshape(len(n), 2), flat, np.concatenate([[0], np.cumsum(n)])


def telling(one: np.ndarray, zero: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Members (with their numbers in the two classes) whose shares in the classes differ beyond chance."""
    df = one + zero
    p = df / (n1 + n0)
    z = np.abs(one / n1 - zero / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return (z > 4) & (df > 2)


@dataclass
class Linear:
    """A logistic model over measures and hashed members, fitted by Adam on balanced classes."""

    dense: np.ndarray
    sparse: np.ndarray
    bias: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))

    def score(self, x: np.ndarray, member: np.ndarray, first: np.ndarray, step: int = 2048) -> np.ndarray:
        ends = [*range(0, len(x), step), len(x)]
        words = [_ragged_sum(self.sparse[member[first[a] : first[b]]], first[a : b + 1] - first[a]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return ((x - self.mean) / self.spread) @ self.dense + np.concatenate([np.zeros(0), *words]) + self.bias

    def __getstate__(self) -> dict:
        """Few members have a weight, and only these are sent."""
        used = np.flatnonzero(self.sparse)
        return self.__dict__ | {"sparse": (len(self.sparse), used, self.sparse[used])}

    def __setstate__(self, state: dict) -> None:
        size, used, weight = state["sparse"]
        self.__dict__.update(state | {"sparse": np.zeros(size)})
        self.sparse[used] = weight

    @classmethod
    def fit(cls, x: np.ndarray, member: np.ndarray, first: np.ndarray, y: np.ndarray, size: int, chosen: np.ndarray | None = None, *, epochs: int = 120, rate: float = 0.05, decay: float = 2e-4) -> Linear:
        """chosen: the members to use (a truth value for each); by default those that tell the classes of these rows apart."""
        m = cls(np.zeros(x.shape[1]), np.zeros(size), 0.0, x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 1e-6 if len(x) else np.ones(x.shape[1]))
        if not 0 < y.sum() < len(y):
            return m
        z = (x - m.mean) / m.spread
        if chosen is None:
            one_, zero_ = (np.bincount(_take((x, member, first), np.flatnonzero(y == k))[1], minlength=size) for k in (1, 0))
            chosen = telling(one_, zero_, y.sum(), len(y) - y.sum())
        # the others never get a weight, and are left out before the turns
        keep = chosen[member]
        row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(first))[keep]
        used, member = np.flatnonzero(chosen), (np.cumsum(chosen) - 1)[member[keep]]
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        theta = np.zeros(z.shape[1] + len(used) + 1)
        one, two = np.zeros_like(theta), np.zeros_like(theta)
        d = z.shape[1]
        for t in range(1, epochs + 1):
            s = z @ theta[:d] + np.bincount(row, theta[d:-1][member], minlength=len(y)) + theta[-1]
            g = weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
            grad = np.concatenate([z.T @ g, np.bincount(member, g[row], minlength=len(used)), [g.sum()]]) + decay * np.append(theta[:-1], 0) / 10
            one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad * grad
            theta -= rate * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.99**t)) + 1e-6)
        m.dense, m.bias = theta[:d], float(theta[-1])
        m.sparse[used] = theta[d:-1]
        return m


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of calibrated log-odds; (0, 0) where one class is missing."""
    if not 0 < y.sum() < len(y):
        return 0.0, 0.0
    scale = score.std() + 1e-9
    x = np.stack([score / scale, np.ones(len(y))], 1)
    w = np.zeros(2)
    for _ in range(30):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - y) + 0.1 * w * [1, 0])
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else (0.0, float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))))


def best_cut(p: np.ndarray, y: np.ndarray, worth: float = 10.0) -> float:
    """The probability that parts the classes best, a wrongly rejected share counting `worth` times a wrongly kept one."""
    order = np.argsort(-p, kind="stable")
    gain = np.cumsum(y[order]) / y.sum() - worth * np.cumsum(1 - y[order]) / (len(y) - y.sum())
    ends = np.flatnonzero(np.append(np.diff(p[order]) != 0, True))
    at = ends[gain[ends].argmax()]
    if gain[at] <= 0:
        return 1.0
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def _take(part: tuple, rows: np.ndarray) -> tuple:
    """Some rows, in order."""
    x, member, first = part
    n = np.diff(first)
    chosen = np.zeros(len(n), bool)
    chosen[rows] = True
    return x[rows], member[np.repeat(chosen, n)], np.concatenate([[0], np.cumsum(n[rows])])


@dataclass
class CoTrained:
    """For each head (low quality, toxic): the two views' models, their calibration, the prior log-odds and the cut; taught: pseudo-labels by round (head, learning view, documents of class 0, of class 1)."""

    heads: list[tuple[Linear, Linear, tuple[float, float], tuple[float, float], float, float]]
    taught: list[list[tuple[int, int, int, int]]] = field(default_factory=list)

    def scores(self, text: tuple, meta: tuple) -> list[np.ndarray]:
        """Calibrated probability of each head."""
        out = []
        for a, b, ca, cb, prior, _ in self.heads:
            s = ca[0] * a.score(*text) + ca[1] + (cb[0] * b.score(*meta) + cb[1] - prior)
            out.append(1 / (1 + np.exp(-np.clip(s, -30, 30))))
        return out


SIZES = (1 << BITS, 1 << META_BITS)
#: Counts of members are summed up in the cluster in ranges of this many.
RANGE = 1 << 15


def _rows_of(batch: pa.RecordBatch) -> tuple[tuple, tuple]:
    """Features of the rows (x, w, m, k) of a batch."""

    def part(dense: pa.Array, members: pa.Array, width: int) -> tuple:
        data, off = utf8(members)
        return np.frombuffer(utf8(dense)[0].tobytes()).reshape(-1, width), np.frombuffer(data.tobytes(), np.int32), off // 4

    return part(batch.column(0), batch.column(1), SHAPES), part(batch.column(2), batch.column(3), 2)


#: Steps of evidence (log-odds beyond the prior), 256 for one, from -8 to 8.
STEPS = 4096


#: What a view is worth at least, whatever held-out labels say of it.
LEAST = 0.005


def _marked(score: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the log-odds of a view that teaches; one that does not know the classes still ranks by its score."""
    slope, offset = platt(score, y)
    if slope > 0 or not 0 < prior < 1:
        return slope, offset
    spread = float(score.std()) + 1e-9 if len(score) else 1.0
    return 1 / spread, float(np.log(prior / (1 - prior))) - (float(np.median(score)) / spread if len(score) else 0.0)


def joint(one: np.ndarray, two: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of the two views' evidence and an offset, none below 0, by logistic regression that shrinks a little towards 1 and 0."""
    use, w = np.array([True, True, True]), np.array([1.0, 1.0, 0.0])
    x, to = np.stack([one, two, np.ones(len(y))], 1), np.array([1.0, 1.0, 0.0])
    while True:
        own = x[:, use]
        w = np.where(use, w, 0.0)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (own * (p * (1 - p))[:, None]).T @ own + np.eye(own.shape[1])
            w[use] -= np.linalg.solve(h, own.T @ (p - y) + (w - to)[use])
        if (w[:2] >= 0).all():
            return float(w[0]), float(w[1]), float(w[2])
        use &= np.append(w[:2] >= 0, True)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """The chance that a row of class 1 scores above one of class 0; ties count half."""
    _, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    one = y.sum()
    return float((rank[y == 1].sum() - one * (one + 1) / 2) / (one * (len(y) - one))) if 0 < one < len(y) else 0.5


@dataclass
class Teachers:
    """The models of a round, by head and view, with slope and offset of their evidence, what they are worth, and the first steps for and last steps against."""

    models: list[list[Linear]]
    marks: list[list[tuple[float, float]]]
    worth: list[list[float]]
    priors: list[float]
    edges: list[list[tuple[int, int]]] = field(default_factory=list)

    @classmethod
    def of(cls, models: list[list[Linear]], views: tuple, labels: list[np.ndarray], held: np.ndarray) -> Teachers:
        marks, worth = [], []
        for pair, y in zip(models, labels, strict=True):
            scores = [m.score(*_take(views[v], held)) for v, m in enumerate(pair)]
            marks.append([_marked(s, y[held], y.mean() if len(y) else 0.0) for s in scores])
            worth.append([max(LEAST, 2 * auc(s, y[held]) - 1) for s in scores])
        return cls(models, marks, worth, [float(y.mean()) if len(y) else 0.0 for y in labels])

    def steps_of(self, views: tuple[tuple, tuple]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Head, view and the step of evidence of each row; the middle step is none."""
        for h, pair in enumerate(self.models):
            for v, m in enumerate(pair):
                c, p = self.marks[h][v], self.priors[h]
                if 0 < p < 1:
                    evidence = c[0] * m.score(*views[v]) + c[1] - np.log(p / (1 - p))
                    yield h, v, np.clip(np.rint(evidence * 256) + STEPS // 2, 0, STEPS - 1).astype(np.int64)

    def ranked(self, pool: DataFrame, share: float) -> Teachers:
        """With the edges that leave the share of each class, from the steps of all documents of the pool."""
        got, middle = summed_rows(pool, self._histograms), STEPS // 2
        self.edges = [[(-1, STEPS)] * 2 for _ in self.models]
        for h, p in enumerate(self.priors):
            for v in (0, 1):
                n = got.get(h * 2 + v, np.zeros(STEPS, np.int64))
                up, down = np.cumsum(n[::-1]), np.cumsum(n)
                hi = STEPS - 1 - int(np.searchsorted(up, np.ceil(share * p * n.sum())))
                lo = int(np.searchsorted(down, np.ceil(share * (1 - p) * n.sum())))
                if n.sum():
                    self.edges[h][v] = (min(lo, middle - 1), max(hi, middle + 1))
        return self

    def _histograms(self, views: tuple[tuple, tuple], add: Callable[[int, np.ndarray], None]) -> None:
        for h, v, step in self.steps_of(views):
            add(h * 2 + v, np.bincount(step, minlength=STEPS))

    def sure(self, views: tuple[tuple, tuple]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Head, view that learns, rows and pseudo-labels."""
        for h, v, step in self.steps_of(views):
            lo, hi = self.edges[h][v]
            rows = np.flatnonzero((step >= hi) | (step <= lo))
            yield h, 1 - v, rows, (step[rows] >= hi).astype(np.int64)


def summed_rows(pool: DataFrame, count: Callable) -> dict[int, np.ndarray]:
    """Sums over the pool of what count(views, add) adds under its keys (arrays of int64, summed up in ranges of RANGE)."""
    shared = pool.sparkSession.sparkContext.broadcast(count)  # models: the members that have a weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}

        def add(key: int, own: np.ndarray) -> None:
            n[key] = n[key] + own if key in n else own

        for batch in batches:
            shared.value(_rows_of(batch), add)
        key, blob = [], []
        for k, own in n.items():
            for r, a in enumerate(range(0, len(own), RANGE)):
                key.append(k * 64 + r)
                blob.append(zlib.compress(own[a : a + RANGE].astype(np.int64).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(blob, pa.binary())], ["key", "blob"])

    def total(rows: pa.Table) -> pa.Table:
        own = sum(np.frombuffer(zlib.decompress(b.as_py()), np.int64) for b in rows["blob"])
        return pa.table({"key": rows["key"].slice(0, 1), "blob": pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())})

    rows = pool.mapInArrow(run, "key int, blob binary").groupBy("key").applyInArrow(total, "key int, blob binary").collect()
    shared.unpersist()
    got = {r["key"]: np.frombuffer(zlib.decompress(r["blob"]), np.int64) for r in rows}
    return {k: np.concatenate([got[x] for x in sorted(got) if x // 64 == k]) for k in {x // 64 for x in got}}


def _members(teachers: Teachers, views: tuple[tuple, tuple], add: Callable[[int, np.ndarray], None]) -> None:
    """Pseudo-labelled documents by class and member, with the numbers of documents at the end of each class."""
    for h, v, rows, y in teachers.sure(views):
        _, member, first = _take(views[v], rows)
        own = np.zeros((2, SIZES[v] + 1), np.int64)
        own[:, -1] = np.bincount(y, minlength=2)
        own[:, :-1] = np.bincount(member + SIZES[v] * np.repeat(y, np.diff(first)), minlength=2 * SIZES[v]).reshape(2, -1)
        add(h * 2 + v, own.ravel())


def counted(pool: DataFrame, teachers: Teachers) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each head and view: pseudo-labelled documents of the two classes in the pool, and how many of them hold each member."""
    got = summed_rows(pool, partial(_members, teachers))
    out = {}
    for h in range(len(teachers.models)):
        for v in (0, 1):
            whole = got.get(h * 2 + v, np.zeros(2 * (SIZES[v] + 1), np.int64)).reshape(2, -1)
            out[h, v] = whole[:, -1], whole[:, :-1]
    return out


def _gradient(z: np.ndarray, member: np.ndarray, first: np.ndarray, y: np.ndarray, theta: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of each model (rows of theta: measures, members, bias); weight: of the classes 0 and 1 in each model."""
    out, d, row = np.zeros_like(theta), z.shape[1], np.repeat(np.arange(len(y)), np.diff(first))
    for i, t in enumerate(theta):
        s = z @ t[:d] + _ragged_sum((t[d:-1] * mask[i])[member], first) + t[-1]
        g = weight[i][y] * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
        out[i] = np.concatenate([z.T @ g, np.bincount(member, g[row], minlength=mask.shape[1]) * mask[i], [g.sum()]])
    return out


def fitted(views: tuple[tuple, tuple], labels: list[np.ndarray], subsets: list[list[np.ndarray]], pool: DataFrame | None, teachers: Teachers | None, taught: list | None = None, *, turns: int = 24, rate: float = 0.05, decay: float = 2e-4) -> list[list[list[Linear]]]:
    """Models of each head, view and subset of labelled rows, fitted on these and on all pseudo-labelled documents of the pool.

    taught: gets (head, learning view, documents of class 0, of class 1).
    """
    seen = counted(pool, teachers) if pool is not None and teachers else {}
    if taught is not None:
        taught += [(h, v, *n.tolist()) for (h, v), (n, _) in seen.items()]
    out: list[list[list[Linear]]] = []
    plan = {}
    for h, y in enumerate(labels):
        out.append([])
        for v in (0, 1):
            n, c = seen.get((h, v), (np.zeros(2), None))
            models, masks, weights = [], [], []
            for rows in subsets[h]:
                own, target = _take(views[v], rows), y[rows]
                have = np.bincount(target, minlength=2)
                if not n.all() or not have.all():
                    models.append(Linear.fit(*own, target, SIZES[v]))
                    continue
                # all pseudo-labelled documents of a class together weigh no more than its labelled ones
                each = np.minimum(1.0, have / np.maximum(n, 1)) * teachers.worth[h][1 - v]
                total = have + each * n
                count = [np.bincount(_take(own, np.flatnonzero(target == k))[1], minlength=SIZES[v]) + each[k] * c[k] for k in (0, 1)]
                masks.append(telling(count[1], count[0], total[1], total[0]))
                models.append(Linear.fit(*own, target, SIZES[v], masks[-1]))
                weights.append((0.5 / total, each))
            out[h].append(models)
            if masks and len(masks) == len(models):
                used = np.flatnonzero(np.any(masks, axis=0))
                # the models of a head and view share the measures' scale, so that documents are stored once
                mean, spread = np.mean([m.mean for m in models], axis=0), np.mean([m.spread for m in models], axis=0)
                theta = [np.concatenate([m.dense * spread / m.spread, m.sparse[used], [m.bias + ((mean - m.mean) / m.spread) @ m.dense]]) for m in models]
                plan[h, v] = (used, np.array(masks)[:, used].astype(np.float64), mean, spread, np.array(theta), np.array([w for w, _ in weights]), np.array([w * e for w, e in weights]))
    if not plan:
        return out
    place = {key: np.full(SIZES[key[1]], -1) for key in plan}
    for key, (used, *_) in plan.items():
        place[key][used] = np.arange(len(used))
    scale = {key: p[2:4] for key, p in plan.items()}
    shared = pool.sparkSession.sparkContext.broadcast((teachers, place, scale))

    def small(x: np.ndarray, member: np.ndarray, first: np.ndarray, key: tuple, place: dict, scale: dict) -> tuple:
        at = place[key][member]
        n = np.concatenate([[0], np.cumsum(at >= 0)])[first]
        return (x - scale[key][0]) / scale[key][1], at[at >= 0].astype(np.int32), n

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teachers, place, scale = shared.value
        for batch in batches:
            got = _rows_of(batch)
            parts = {(h, v): (*small(*_take(got[v], rows), (h, v), place, scale), y.astype(np.int8)) for h, v, rows, y in teachers.sure(got) if (h, v) in place and len(rows)}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts, 5)], pa.binary())], ["blob"])

    # one task a core reads it, as it is small and read once in every turn
    stored = cut(pool.mapInArrow(shrink, "blob binary"))
    stored = stored.coalesce(max(1, pool.sparkSession.sparkContext.defaultParallelism))
    thetas = {key: p[4] for key, p in plan.items()}
    own = {(h, v): [(*small(*_take(views[v], rows), (h, v), place, scale), labels[h][rows]) for rows in subsets[h]] for h, v in plan}
    pace = {key: (np.zeros_like(t), np.zeros_like(t)) for key, t in thetas.items()}
    masks, shares = {key: p[1] for key, p in plan.items()}, {key: p[6] for key, p in plan.items()}
    keys = sorted(plan)

    def summed(thetas: dict) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {key: np.zeros_like(thetas[key]) for key in keys}
            for batch in batches:
                for blob in batch.column(0):
                    for key, (z, member, first, y) in pickle.loads(blob.as_py()).items():
                        total[key] += _gradient(z, member, first, y, thetas[key], masks[key], shares[key])
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total[key].ravel() for key in keys]).tobytes()], pa.binary())], ["blob"])

        return [np.frombuffer(r["blob"]) for r in stored.mapInArrow(run, "blob binary").collect()]  # one row for each task

    for t in range(1, turns + 1):
        whole = np.sum(summed(thetas), axis=0)
        parts = np.split(whole, np.cumsum([thetas[key].size for key in keys])[:-1])
        for key, part in zip(keys, parts, strict=True):
            theta, (one, two) = thetas[key], pace[key]
            grad = part.reshape(theta.shape) + decay / 10 * np.concatenate([theta[:, :-1], np.zeros((len(theta), 1))], axis=1)
            for i, rows in enumerate(own[key]):
                grad[i] += _gradient(*rows, theta[i : i + 1], masks[key][i : i + 1], plan[key][5][i : i + 1])[0]
            one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad * grad
            pace[key] = one, two
            thetas[key] = theta - rate * (1 - (t - 1) / turns) * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.99**t)) + 1e-6)
    for (h, v), theta in thetas.items():
        used, mask, mean, spread, *_ = plan[h, v]
        d = len(mean)
        for i, t in enumerate(theta):
            sparse = np.zeros(SIZES[v])
            sparse[used] = t[d:-1] * mask[i]
            out[h][v][i] = Linear(t[:d], sparse, float(t[-1]), mean, spread)
    return out


def co_train(text: tuple, meta: tuple, labels: list[np.ndarray], pool: DataFrame | None = None, *, rounds: int = 2, share: float = 0.15, seed: int = 3) -> CoTrained:
    """text, meta, labels (0 or 1 for each head): of the labelled rows; pool: features (x, w, m, k) of all unlabelled documents."""
    views, n = (text, meta), len(labels[0])
    part = np.random.default_rng(seed).integers(0, 4, n)
    held, train = np.flatnonzero(part == 0), np.flatnonzero(part != 0)
    teachers, rounds_ = None, []
    for turn in range(rounds if pool is not None else 0):
        rounds_.append([])
        models = [[of_view[0] for of_view in head] for head in fitted(views, labels, [[train]] * len(labels), pool, teachers, rounds_[-1])]
        teachers = Teachers.of(models, views, labels, held).ranked(pool, share * (turn + 1))
    rounds_.append([])
    # calibration and the cut on scores of models that have not seen the row; the models themselves on all rows
    everything = np.arange(n)
    subsets = [[everything, *[np.flatnonzero(part != f) for f in range(4)]]] * len(labels)
    heads = []
    for y, (a, b) in zip(labels, fitted(views, labels, subsets, pool, teachers, rounds_[-1]), strict=True):
        if not 0 < y.sum() < n:
            heads.append((a[0], b[0], (0.0, -30.0), (0.0, 0.0), 0.0, 0.5))
            continue
        prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        unseen = np.zeros((2, n))
        for f in range(4):
            rows = np.flatnonzero(part == f)
            for v, models in enumerate((a, b)):
                unseen[v, rows] = models[1 + f].score(*_take(views[v], rows))
        one, two = (platt(unseen[v], y) for v in (0, 1))
        u, v, offset = joint(one[0] * unseen[0] + one[1], two[0] * unseen[1] + two[1] - prior, y)
        marks = [(u * one[0], u * one[1] + offset), (v * two[0], v * (two[1] - prior) + prior)]
        both = marks[0][0] * unseen[0] + marks[0][1] + marks[1][0] * unseen[1] + marks[1][1] - prior
        heads.append((a[0], b[0], *marks, prior, best_cut(1 / (1 + np.exp(-np.clip(both, -30, 30))), y)))
    return CoTrained(heads, rounds_)


@dataclass(frozen=True)
class Bounds:
    """Labelled rows of each class that fitting may use; unlabelled ones are all used."""

    max_labelled: int = 3000
    seed: int = 23


#: Columns that are read, and their usual names.
COLUMNS = {"id": "doc_id", "text": "text", "lang": "lang", "source": "source", "chars": "n_chars"}


def _features(part: list, a: int, b: int) -> tuple[tuple, tuple]:
    """Features of rows a to b of the columns named in COLUMNS."""
    data, off = utf8(part[1].slice(a, b - a))
    words = lambda c: [x or "" for x in c.slice(a, b - a).cast(pa.string()).to_pylist()]
    size = np.array([x or 0 for x in part[4].slice(a, b - a).to_pylist()], np.float64)
    return text_features(data, off), meta_features(words(part[2]), words(part[3]), size)


def train(docs: DataFrame, labels: DataFrame, *, bounds: Bounds = Bounds(), columns: dict[str, str] | None = None) -> CoTrained:  # noqa: B008
    """Fit on a bounded sample of labels (doc_id, quality, toxic) and on all unlabelled documents."""
    names = COLUMNS | (columns or {})
    rows = docs.select(*[F.col(names[k]).alias(k) for k in COLUMNS]).withColumn("id", F.col("id").cast("long"))
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    # 1: low quality, 2: toxic, 3: both
    known = known.agg((F.max((F.col("quality") == 0).cast("int")) + 2 * F.max((F.col("toxic") == 1).cast("int"))).alias("kind"))
    unit = F.pmod(F.xxhash64(F.lit(bounds.seed), "id"), F.lit(1 << 20))
    sizes = {r["kind"]: r["count"] for r in known.groupBy("kind").count().collect()}
    share = F.lit(0)
    for kind, n in sizes.items():
        share = F.when(F.col("kind") == kind, min(1 << 20, int((1 << 20) * bounds.max_labelled / n))).otherwise(share)
    # labelled documents that are not chosen have kind -2, unlabelled ones -1
    known = known.select("id", F.when(unit < share, F.col("kind")).otherwise(-2).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.columns
            _, off = utf8(part[1])
            for a, b in steps(off):
                (x, w, wf), (m, k, kf) = _features(part, a, b)
                body = lambda v, first, t: pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((first * np.dtype(t).itemsize).astype(np.int32)), pa.py_buffer(v.astype(t).tobytes())])  # noqa: B023, E731
                dense = lambda v: body(v, np.arange(b - a + 1) * v.shape[1], np.float64)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), dense(x), body(w, wf, np.int32), dense(m), body(k, kf, np.int32)], ["id", "x", "w", "m", "k"])

    # features alone move, and are written once, as every round reads those of all unlabelled documents
    body = ["x", "w", "m", "k"]
    features = rows.select(*COLUMNS).mapInArrow(run, "id long, x binary, w binary, m binary, k binary")
    features = cut(features.join(known.hint("shuffle_hash"), "id", "left").select("id", F.coalesce("kind", F.lit(-1)).alias("kind"), *body))
    got = features.where("kind >= 0").toArrow().sort_by([("id", "ascending"), ("kind", "ascending")]).combine_chunks()
    if got.num_rows:
        text, meta = _rows_of(got.select(body).to_batches()[0])
    else:
        text, meta = ((np.zeros((0, width)), np.zeros(0, np.int64), np.zeros(1, np.int64)) for width in (SHAPES, 2))
    kind = got["kind"].to_numpy().astype(np.int64)
    del got
    pa.default_memory_pool().release_unused()
    low, toxic = kind & 1, kind >> 1
    return co_train(text, meta, [low, toxic], features.where("kind = -1").select(*body), seed=bounds.seed)


def score(docs: DataFrame, model: CoTrained, *, whole: bool = False, columns: dict[str, str] | None = None) -> DataFrame:
    """doc_id, low_quality, toxic (probabilities), score (that neither holds) and keep (both below their cuts) of each row.

    whole: all columns of docs instead of doc_id, and the results under the names _bl_low, _bl_toxic, _bl_score, _bl_keep.
    """
    names = COLUMNS | (columns or {})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: two hashed tables for each head
    rows = docs if whole else docs.select(*[F.col(names[k]).alias(k) for k in COLUMNS])
    at = [rows.columns.index(names[k] if whole else k) for k in COLUMNS]
    made = [("_bl_low", "low_quality"), ("_bl_toxic", "toxic"), ("_bl_score", "score"), ("_bl_keep", "keep")]
    heads = [a if whole else b for a, b in made]
    own = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields] if whole else [("doc_id", rows.schema["id"].dataType.simpleString())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            part = [batch.column(i) for i in at]
            _, off = utf8(part[1])
            low, toxic = [np.zeros(0)], [np.zeros(0)]
            for a, b in steps(off):
                p, q = model.scores(*_features(part, a, b))
                low.append(p)
                toxic.append(q)
            p, q = np.concatenate(low), np.concatenate(toxic)
            keep = (p < model.heads[0][-1]) & (q < model.heads[1][-1])
            out = [pa.array(p), pa.array(q), pa.array((1 - p) * (1 - q)), pa.array(keep)]
            yield pa.RecordBatch.from_arrays([*(batch.columns if whole else part[:1]), *out], [n for n, _ in own] + heads)

    fields = own + list(zip(heads, ("double", "double", "double", "boolean"), strict=True))
    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))
