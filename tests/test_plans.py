"""Planning on arrays: golden cases, invariants, and agreement of all policies. No Spark."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bandloom.errors import HistogramError, JoinError, PartitioningError, RearrangementError
from bandloom.functions.bands import Band, BandQuery, random_query
from bandloom.functions.java_random import JavaRandom
from bandloom.operators.grid import Grid
from bandloom.operators.histogram import Histogram, optimal_bounds, step_bounds
from bandloom.plans import mbucket, merge, search, seriation, virtual

AT = np.arange(10)
TEN = Histogram(10 * AT + 1, 10 * AT + 10, np.full(10, 10, np.int64))


def ten(query: str) -> Grid:
    return Grid.of(TEN, TEN, query)


def loads(freq: dict[int, int], k: int) -> list[int]:
    value, n = np.array(list(freq)), np.array(list(freq.values()))
    last = step_bounds(value, n, k)
    return [int(x.sum()) for x in np.split(n, last + 1)]


def test_java_random_draws():
    zero, one = JavaRandom(0), JavaRandom(1)
    assert [zero.next_double() for _ in range(4)] == [0.730967787376657, 0.24053641567148587, 0.6374174253501083, 0.5504370051176339]
    assert [one.next_double() for _ in range(4)] == [0.7308781907032909, 0.41008081149220166, 0.20771484130971707, 0.3327170559595112]


@pytest.mark.parametrize(
    ("bands", "seed", "query", "cells", "pairs"),
    [(1, 0, "[-51|-50]", 9, 99), (1, 1, "[-21|-20]", 15, 159), (2, 0, "[-71|-70]_[51|70]", 17, 849), (2, 1, "[-61|-60]_[11|30]", 31, 1669), (3, 0, "[-81|-80]_[-1|10]_[61|80]", 40, 1773), (3, 1, "[-71|-70]_[-21|-20]_[41|60]", 35, 1208)],
)
def test_random_queries(bands, seed, query, cells, pairs):
    q = random_query(bands, 1, seed, TEN.lo.tolist(), TEN.hi.tolist(), TEN.lo.tolist(), TEN.hi.tolist())
    assert str(q) == query
    assert ten(query).candidate_cells == cells
    v = np.arange(1, 101)
    d = v[:, None] - v[None, :]
    assert sum(int(((d >= b.lo) & (d <= b.hi)).sum()) for b in q.bands) == pairs


def test_bands():
    q = BandQuery.parse("[0|5]_[3|8]_[10|]")
    assert str(q) == "[0|5]_[3|8]_[10|]"
    assert q.merged().bands == (Band(0, 8), Band(10, None))
    assert BandQuery.parse("[0|5]_[6|8]").merged().bands == (Band(0, 8),)
    assert BandQuery.parse("[|2]_[-1|9]").merged().bands == (Band(None, 9),)
    assert str(BandQuery.parse("[1|3]").negated()) == "[-3|-1]"
    for bad in ("", "[1,2]", "1|2", "[3|1]"):
        with pytest.raises(JoinError):
            BandQuery.parse(bad)


def test_step_bounds():
    assert loads({1: 100, 2: 1, 3: 1, 4: 1}, 3) == [100, 2, 1]
    assert loads({i: 1 for i in range(1, 8)}, 3) == [3, 3, 1]
    assert loads({i: 1 for i in range(1, 101)}, 10) == [10] * 10
    with pytest.raises(HistogramError):
        step_bounds(np.arange(3), np.ones(3, np.int64), 4)


def restarting_walk(freq: np.ndarray, k: int) -> list[int]:
    target = freq.sum() / k
    while True:
        ends, load = [], 0
        for i, n in enumerate(freq):
            load += n
            if len(ends) < k - 1 and load >= target:
                ends.append(i)
                load = 0
        if len(ends) == k - 1 and ends[-1] < len(freq) - 1:
            return ends
        target -= 1


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 40), min_size=2, max_size=40), st.integers(2, 8))
def test_step_bounds_as_the_plain_walk(freq, k):
    n = np.array(freq)
    if len(n) < k:
        return
    assert step_bounds(np.arange(len(n)), n, k).tolist() == restarting_walk(n, k)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 40), min_size=3, max_size=30), st.integers(2, 6))
def test_optimal_bounds_fill_all(freq, k):
    n = np.array(freq)
    if len(n) < k:
        return
    cut = optimal_bounds(np.arange(len(n)), n, k)
    assert len(cut) == k - 1 and all(np.diff(np.concatenate([[-1], cut, [len(n) - 1]])) > 0)


def test_find_outside():
    assert TEN.find(np.array([0, 1, 10, 11, 100, 101])).tolist() == [-1, 0, 0, 1, 9, -1]


def test_grid():
    g = ten("[0|0]")
    assert g.candidate_cells == 10 and set(g.weight[g.possible]) == {20} and g.output_cost == 1000
    assert ten("[-1|1]").candidate_cells == 28
    assert ten("[-1|1]").candidates_between(0, 0) == 2
    moved = ten("[-1|1]").permuted(AT[::-1])
    assert moved.candidate_cells == 28 and moved.s_ids.tolist() == AT[::-1].tolist()
    with pytest.raises(RearrangementError):
        moved.permuted(np.zeros(10, int))
    empty = Histogram(TEN.lo, TEN.hi, np.zeros(10, np.int64))
    assert Grid.of(empty, empty, "[0|0]").candidate_cells == 0
    t = ten("[5|9]").transposed()
    assert (t.possible == ten("[5|9]").possible.T).all() and str(t.query) == "[-9|-5]"


def test_m_bucket_golden():
    a = mbucket.find_lowest(ten("[0|0]"), 5)
    assert a.cap == 40 and a.partitions == 5
    m = a.metrics()
    assert (m["BJmaxIC"], m["BJmaxCC"], m["BJmaxB"], m["BJrepIC"], m["BJrepB"], m["BJimbIC"], m["BJstdevIC"]) == (40, 2, 4, 1, 1, 1, 0)
    assert (m["SJmaxIC"], m["SJrepIC"]) == (20, 1)
    two = mbucket.find_lowest(ten("[0|0]"), 2)
    assert two.cap == 100 and two.partitions == 2 and two.metrics()["BJmedianIC"] == 100


def test_merge_golden():
    a = merge.find_lowest(ten("[0|0]"), 5, "AICPM")
    assert a.cap == 40 and sorted(a.costs()["cells"]) == [2] * 5


POLICIES = ["MBI", "MBIREP", "AICPM", "AICPS", "ACCPM", "EPIC", "EPCC", "JB", "M", "WICRC_1_2", "targetf"]


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("query", ["[0|0]", "[-1|1]", "[-71|-70]_[51|70]", "[0|5]_[3|8]"])
@pytest.mark.parametrize("partitions", [1, 2, 5, 60])
def test_every_cell_once_within_cap(policy, query, partitions):
    limit = merge.MAX_CELLS if policy == "EPCC" else merge.MAX_INPUT
    a = search.make(ten(query), partitions, policy, limit=limit)
    check = search.coverage(a)
    assert check["missing"] == check["foreign"] == 0
    assert a.partitions <= partitions
    assert policy == "EPCC" or check["over_cap"] == 0


def test_rectangles_are_disjoint():
    g = virtual.virtual_grid(40, 5, 3, 0, "randomstep")
    a = mbucket.find_lowest(g, 12)
    seen = np.zeros(g.possible.shape, int)
    for r0, c0, r1, c1 in a.rectangles:
        seen[r0 : r1 + 1, c0 : c1 + 1] += 1
    assert seen.max() == 1 and (seen[g.possible] == 1).all()


@pytest.mark.parametrize("kind", ["diagonal", "horizontal", "vertical"])
def test_block_grids(kind):
    g = virtual.block_grid(100, 50, kind)
    assert g.candidate_cells == 50
    a = mbucket.find_lowest(g, 50)
    assert search.coverage(a)["missing"] == 0


def test_no_cap_is_enough():
    assert mbucket.at_cap(ten("[0|0]"), 5, 10) is None
    assert merge.merged(ten("[0|0]"), 5, "AICPM", 10) is None
    with pytest.raises(PartitioningError):
        merge.measure_of("XYZ")


def test_caps_and_weights():
    assert search.caps(100, 200, 11) == [200, 191, 182, 173, 164, 155, 146, 137, 128, 119, 100]
    assert search.caps(7, 7, 11) == [7]
    assert search.parse_weights("BJrepIC_0.5-BJmaxIC_0.5|BJmaxCC_1") == [{"BJrepIC": 0.5, "BJmaxIC": 0.5}, {"BJmaxCC": 1.0}]
    assert search.normalized_weights([{"a": 1, "b": 3}]) == [{"a": 0.25, "b": 0.75}]


def energy(m: np.ndarray) -> float:
    return float((m[1:] * m[:-1]).sum())


def test_bond_energy_brings_like_rows_together():
    m = np.array([[1, 0, 1, 0, 1], [0, 1, 0, 1, 0], [1, 0, 1, 0, 1], [0, 1, 0, 1, 0], [1, 0, 1, 0, 1]])
    order = seriation.bond_energy_order(seriation.bonds(m))
    assert sorted(order) == list(range(5)) and energy(m[order]) == 2 * 3 + 2
    big = 2**63 - 1
    four = np.array([[0, 0, 0, 0], [big, 0, big, 0], [big, 5, big, 0], [1, 0, big, 0]], object).astype(float)
    assert sorted(seriation.bond_energy_order(seriation.bonds(four))) == [0, 1, 2, 3]


def test_radius_one_is_plain_bond_energy():
    m = ten("[-1|1]_[40|45]").weight
    assert np.allclose(seriation.radius_bonds(m, 1), seriation.bonds(m))


@pytest.mark.parametrize("policy", ["BEA", "BEARadius", "TSPk", "TSPkTransposedOnDefault", "TSPkTransposedOnRearranged"])
def test_orders_are_permutations(policy):
    g = ten("[-71|-70]_[51|70]")
    moved = seriation.rearranged(g, policy)
    assert moved.candidate_cells == g.candidate_cells and sorted(moved.s_ids) == sorted(moved.t_ids) == list(range(10))
    a = mbucket.find_lowest(moved, 4)
    assert search.coverage(a)["missing"] == 0


def test_tour_is_cut_at_a_dummy():
    x = np.array([[0, 0, 9, 9], [9, 9, 0, 0], [0, 0, 9, 8], [9, 8, 0, 0]])
    order = seriation.tour_order(x, 2).tolist()
    assert sorted(order) == [0, 1, 2, 3] and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    assert seriation.cut_tour(np.array([1, 4, 0, 2, 5, 3]), 4).tolist() == [0, 2, 3, 1]


def test_pearson_distance():
    d = seriation.pearson_distances(np.array([[1, 0, 1, 0], [1, 0, 1, 0], [0, 1, 0, 1], [1, 1, 1, 1]]))
    assert d[0, 1] == 0 and d[0, 2] == 10000 and d[0, 3] == 5000


def test_pearson_distance_leaves_out_missing_values():
    rng = np.random.default_rng(4)
    m = rng.integers(0, 50, (6, 30)).astype(float)
    m[rng.random(m.shape) < 0.2] = 1000
    m[5], m[4, :] = 1000, 7
    got = seriation.pearson_distances(m, None)
    for a in range(6):
        for b in range(6):
            both = (m[a] < 1000) & (m[b] < 1000)
            x, y = m[a][both], m[b][both]
            cov = ((x - x.mean()) * (y - y.mean())).mean() if len(x) else 0.0
            r = cov / (x.std() * y.std()) if abs(cov) >= 1e-5 else 0.0
            assert got[a, b] == int(np.floor(5000 - 5000 * min(1, max(-1, r)) + 0.5 + 1e-9)) or abs(got[a, b] - (5000 - 5000 * r)) <= 0.5 + 1e-6
