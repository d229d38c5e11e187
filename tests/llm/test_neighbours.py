"""Operator 11 against brute force: recall, exactness where windows hold all rows, copies, ties and odd rows."""

import itertools

import numpy as np
import pytest

from gridloom.llm import op11_neighbours
from gridloom.llm.hilbert import Curves, curve_position

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v double, o int, block int, first long, query long, score double"
EXTRA = (1, 2, 3.0, 4, 5, 6, 7, 8.0)


def frame(spark, rows):
    """Extra columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *EXTRA) for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.asarray(v) != 0)]
    out = []
    for q, a in ok:
        if q % every == 0:
            near = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in ok if i != q)
            out += [(q, r, i, round(s, 9)) for r, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize(("dims", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = curve_position(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_curves_are_shifted_and_differ():
    x = np.random.default_rng(0).normal(size=(500, 12))
    curves = Curves.fit(x, 3, 4, 6)
    keys = [curves.keys(x, o) for o in range(3)]
    assert len({tuple(np.argsort(k)) for k in keys}) == 3 and all(0 <= k.min() and k.max() < 1 << 24 for k in keys)
    assert len(np.unique(curves.shifts)) == curves.shifts.size


def test_neighbours_equal_sql(spark, sf_dir, same):
    same(op11_neighbours.query(spark, sf_dir), op11_neighbours.ORACLE)


def test_recall_with_windows_far_under_all_rows(spark):
    """Clusters of few dimensions in 32: windows of some per cent hold 0.9 of the neighbours and more."""
    rng = np.random.default_rng(1)
    centres, planes = rng.normal(size=(20, 32)), rng.normal(size=(20, 3, 32)) / 6
    at = rng.integers(0, 20, 6000)
    x = centres[at] + np.einsum("nk,nkd->nd", rng.normal(size=(6000, 3)), planes[at]) + rng.normal(size=(6000, 32)) / 300
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(op11_neighbours.search(frame(spark, rows), least_window=40, least_block=40))
    want = brute(rows)
    assert len({(q, r) for q, r, *_ in got}) == len(got) == len(want) == 600
    recall = len({(q, c) for q, _, c, _ in got} & {(q, c) for q, _, c, _ in want}) / len(want)
    assert recall >= 0.9
    exact = {(i, j): s for i, _, j, s in want}
    assert all(exact.get((q, c), s) == s for q, _, c, s in got)


def test_recall_where_vectors_have_no_structure(spark):
    """Uniform directions in 64 dimensions: the measured windows widen until they hold enough."""
    x = np.random.default_rng(2).normal(size=(5000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    got, want = found(op11_neighbours.search(frame(spark, rows), least_window=64, least_block=64)), brute(rows)
    assert len({(q, c) for q, _, c, _ in got} & {(q, c) for q, _, c, _ in want}) / len(want) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    """A vector that a third of all rows hold, ties on a lattice, nulls, zeros, infinities, other lengths, -0.0, repeated rows."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 2.0]) for i in range(0, 400)] + [(i, [-1.0, -0.0, float(i % 7)]) for i in range(400, 700)] + [(i, [-1.0, 0.0, float(i % 7)]) for i in range(700, 760)]
    rows += [(i, [float(i % 5), float(i % 4), float(i % 3)]) for i in range(800, 1001)]
    odd = [(1100, None), (1101, []), (1102, [0.0, 0.0, 0.0]), (1200, [0.0, -0.0, 0.0]), (1103, [1.0, None, 1.0]), (1300, [nan, 1.0, 1.0]), (1104, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    other = [(1400, [1.0, 2.0]), (1401, [1.0])]
    rows = [r for r in rows if not (r[1] and not any(r[1]))]
    want = brute(rows)
    assert found(op11_neighbours.search(frame(spark, rows + odd + other + rows[:3] + rows[500:502]))) == want


def test_few_rows(spark):
    few = [(0, [1.0, 2.0]), (100, [1.0, 2.5]), (7, [3.0, 3.0])]
    assert found(op11_neighbours.search(frame(spark, few))) == brute(few)
    assert found(op11_neighbours.search(frame(spark, few[:1]))) == []
    assert found(op11_neighbours.search(frame(spark, few).limit(0))) == []
    assert found(op11_neighbours.search(frame(spark, [(1, [1.0]), (2, [2.0])]))) == []
