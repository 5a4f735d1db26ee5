"""Ranks and rank correlations of groups of any size."""

import random

import numpy as np
import pytest

from tessera.operators import windows as W


def rows():
    rng = random.Random(6)
    out = []
    for g, n, values in ((1, 500, 40), (2, 300, 10**6), (None, 120, 3), (3, 1, 5), (4, 2, 1), (5, 200, 200)):
        for _ in range(n):
            x = rng.randrange(values)
            y = x + rng.randrange(values) if g != 5 else -x
            out.append((g, float(x), float(y)))
    out += [(2, None, 1.0), (2, float("nan"), 1.0), (1, 1.0, float("inf"))]
    out += [(6, 7.0, float(i)) for i in range(90)] + [(6, float(i), 3.0) for i in range(60)]
    return out


def brute(points):
    x, y = (np.array(v) for v in zip(*points, strict=True))
    s = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    s = s[np.triu_indices(len(x), 1)]
    return (float(s.sum() / (s != 0).sum()) if (s != 0).any() else 0.0), len(x)


@pytest.mark.parametrize("bucket", [8, 1024])
def test_kendall_equals_all_pairs(spark, bucket):
    d = spark.createDataFrame(rows(), "g int, x double, y double")
    got = {r.g: r for r in W.kendall_tau(d, ["g"], "x", "x", "y", bucket).collect()}
    want = {}
    for g, x, y in rows():
        if x is not None and np.isfinite([x, y]).all():
            want.setdefault(g, []).append((x, y))
    assert got.keys() == want.keys()
    for g, points in want.items():
        tau, n = brute(points)
        assert (got[g].tau, got[g].n) == (pytest.approx(tau, abs=1e-12), n)
        assert got[g].z == pytest.approx(tau / np.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))) if n > 1 else 0.0)


def test_ranks_equal_numpy(spark):
    d = spark.createDataFrame(rows(), "g int, x double, y double")
    own = {}
    for g, x, _ in rows():
        own.setdefault(g, []).append(x)
    for r in W.rank_transform(d, ["g"], "x", out="rank").collect():
        good = [v for v in own[r.g] if v is not None and v == v]
        if r.x is None or r.x != r.x:
            assert r["rank"] == len(good) + (len(own[r.g]) - len(good) + 1) / 2
        else:
            assert r["rank"] == sum(v < r.x for v in good) + (sum(v == r.x for v in good) + 1) / 2
