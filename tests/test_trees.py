"""Spanning trees, single linkage and factorial designs against plain Python."""

import itertools
import random

import numpy as np
import pytest

from tessera.operators import anova as A
from tessera.operators import trees as T


def kruskal(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    tree = set()
    for w, a, b in sorted((w, *sorted((a, b))) for a, b, w in edges if w is not None and a != b):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            tree.add((a, b, w))
    return tree, {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "chain", "empty"])
def test_spanning_tree_and_single_linkage(spark, shape):
    rng = random.Random(4)
    nodes = list(range(60))
    edges = [(rng.randrange(50), rng.randrange(50), float(rng.randrange(6))) for _ in range(150)] if shape == "random" else [(i, i + 1, float(i)) for i in range(50)] if shape == "chain" else []
    edges += [(1, 1, 0.0), (2, 3, None)]
    d = spark.createDataFrame(edges, "p int, q int, d double")
    tree = T.spanning_tree(d, "p", "q", "d")
    assert {(r.a, r.b, r.w) for r in tree.collect()} == kruskal(edges, nodes)[0]
    heights = [-1.0, 1.0, 3.0, 99.0]
    got = {(r.id, r.height): r.cluster for r in T.single_linkage(spark.createDataFrame([(n,) for n in nodes], "id int"), "id", tree, heights).collect()}
    for h in heights:
        want = kruskal([e for e in edges if e[2] is not None and e[2] <= h], nodes)[1]
        assert {n: got[n, h] for n in nodes} == want


def test_factorial_design_with_unequal_groups_and_gaps(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(11):
        g = "xyz"[s % 3 if s < 9 else 0]
        for a, b in itertools.product(range(3), range(2)):
            rows += [(s, g, a, b, float(rng.normal() + a * (g == "x") + 1e7))] * (2 if s == 0 else 1)
    whole = spark.createDataFrame(rows, "s int, g string, a int, b int, v double")
    got = {r.effect: r for r in A.factorial(whole, "s", ["g"], ["a", "b"], "v").collect()}
    cells = {(s, g, a, b): v for s, g, a, b, v in rows}
    x = np.array([[[cells[s, g, a, b] for b in range(2)] for a in range(3)] for s, g in sorted({(s, g) for s, g, *_ in rows})]) - np.mean(list(cells.values()))
    group = np.array([g for _, g in sorted({(s, g) for s, g, *_ in rows})])
    m = x.mean(axis=(1, 2))
    between = sum((group == g).sum() * 6 * m[group == g].mean() ** 2 for g in "xyz")
    assert (got["g"].ss, got["g"].df, got["g"].error_df) == (pytest.approx(between, rel=1e-6), 2, 8)
    assert got["g"].error_ss == pytest.approx(sum(6 * ((m[group == g] - m[group == g].mean()) ** 2).sum() for g in "xyz"), rel=1e-6)
    am = x.mean(axis=2)
    assert (got["a"].ss, got["a"].df, got["a"].error_df) == (pytest.approx(22 * (am.mean(axis=0) ** 2).sum(), rel=1e-6), 2, 16)
    assert sum(got[e].df for e in ("g", "a", "b", "g:a", "g:b", "a:b", "g:a:b")) + sum(got[e].error_df for e in ("g", "a", "b", "a:b")) == 65
    total = sum(got[e].ss for e in got) + sum(got[e].error_ss for e in ("g", "a", "b", "a:b"))
    assert total == pytest.approx((x**2).sum(), rel=1e-6)
    gaps = whole.union(spark.createDataFrame([(50, "x", 0, 0, 5.0), (51, "y", 1, 1, None)], whole.schema))
    for r in A.factorial(gaps, "s", ["g"], ["a", "b"], "v").collect():
        assert (r.ss, r.df) == (pytest.approx(got[r.effect].ss, rel=1e-9), got[r.effect].df)
    one = {r.effect: r for r in A.factorial(whole, "s", [], ["a"], "v").collect()}
    assert one["a"].df == 2 and one["a"].error_df == 20


def test_mesh_smoothing_equals_matrix_powers(spark):
    from tessera.operators import spatial as X

    rng = np.random.default_rng(8)
    faces = [(i, i + 1, (i + 7) % 20) for i in range(18)]
    edges = X.mesh_edges(spark.createDataFrame(faces, "a int, b int, c int"))
    m = np.zeros((22, 22))
    for r in edges.collect():
        m[r.a, r.b] = m[r.b, r.a] = 1
    x = rng.normal(size=(3, 22))
    d = spark.createDataFrame([(t, v, float(x[t, v])) for t in range(3) for v in range(22)], "t int, v int, x double")
    n = np.maximum(m.sum(axis=1), 1)
    step = np.where(m.sum(axis=1)[:, None] > 0, (np.eye(22) + 0.5 * m / n[:, None]) / 1.5, np.eye(22))
    want = x @ np.linalg.matrix_power(step, 4).T
    got = {(r.t, r.v): r.x for r in X.smooth_mesh(d, edges, "v", ["x"], 0.5, 4, ["t"]).collect()}
    assert len(got) == 66 and all(got[t, v] == pytest.approx(want[t, v]) for t, v in got)
    flat = d.withColumn("x", d.x * 0 + 2)
    assert {r.x for r in X.smooth_mesh(flat, edges, "v", ["x"], 0.5, 50, ["t"], tolerance=1e-12).collect()} == {2.0}
