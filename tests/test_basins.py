"""Basins and flipped maps against plain Python."""

import itertools
import random

import numpy as np
import pytest

from tessera.operators import clusters as C


def brute(values, least, apart):
    """Peak of every cell of {cell: value}."""
    rank = lambda c: (values[c], tuple(-i for i in c))
    near = lambda c: [n for o in itertools.product((-1, 0, 1), repeat=len(c)) if any(o) and (n := tuple(i + j for i, j in zip(c, o, strict=True))) in values]

    def climb(c):
        while True:
            best = max([c, *near(c)], key=rank)
            if best == c:
                return c
            c = best

    peak = {c: climb(c) for c in values}
    while least > 1 or apart > 0:
        joins = {}
        for p in set(peak.values()):
            mine = [c for c in values if peak[c] == p]
            options = []
            for q in {peak[n] for c in mine for n in near(c)} - {p}:
                if rank(q) > rank(p):
                    over = max(min(values[c], values[n]) for c in mine for n in near(c) if peak[n] == q)
                    far = float(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)))
                    close = far < apart**2
                    if close or len(mine) < least:
                        options.append((close, -far if close else over, *rank(q), q))
            if options:
                joins[p] = max(options)[-1]
        if not joins:
            break

        def end(p, joins=joins):
            while p in joins:
                p = joins[p]
            return p

        peak = {c: end(p) for c, p in peak.items()}
    return peak


@pytest.mark.parametrize(("least", "apart"), [(1, 0.0), (6, 0.0), (1, 2.5), (12, 3.0)])
def test_basins_equal_plain_python(spark, least, apart):
    rng = random.Random(least)
    values = {(x, y): float(rng.randrange(12)) for x in range(13) for y in range(11) if rng.random() < 0.8}
    d = spark.createDataFrame([(x, y, v) for (x, y), v in values.items()] + [(50, 50, None)], "x int, y int, v double")
    got = {(r.x, r.y): (r.peak_x, r.peak_y) for r in C.basins(d, ["x", "y"], "v", 2, least, apart).collect()}
    assert got.pop((50, 50)) == (None, None)
    assert got == brute(values, least, apart)


def test_flipped_maps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 6, 6)) * 0.2
    x[:, 1:4, 2:5] += 1.0  # nine cells that every subject has
    rows = [(s, i, j, float(x[s, i, j])) for s in range(12) for i in range(6) for j in range(6)] + [(0, 9, 9, None), (None, 0, 0, 1.0)]
    f = C.flipped_clusters(spark.createDataFrame(rows, "s long, i int, j int, v double"), "s", ["i", "j"], "v", 3.0, 60)
    got = {r.b: r for r in f.collect()}
    assert len(got) == 61 and got[0].largest == 9
    from tessera.operators.stats import draws

    sign = np.where(draws(np.arange(12), np.arange(61), 1) < 0.5, -1.0, 1.0)
    for b in (1, 17, 60):
        m = x * sign[b][:, None, None]
        t = m.mean(axis=0) / (m.std(axis=0, ddof=1) / np.sqrt(12))
        assert got[b].cells == int((t >= 3).sum())
    r = C.required_size(f).first()
    flips = [got[b].largest for b in range(1, 61)]
    assert sum(v >= r.size for v in flips) <= 3 < sum(v >= r.size - 1 for v in flips) or r.size == 1
    assert r.p == pytest.approx((1 + sum(v >= 9 for v in flips)) / 61)
