"""Models over runs against numpy on the stacked designs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import glm as G


def data(offset=0.0):
    rng = np.random.default_rng(7)
    design, series, X, Y = [], [], [], {"a": [], "b": []}
    for run in range(3):
        n = 40 + 5 * run
        x = {p: rng.normal(size=n) for p in ("p", "q", "s")}
        x["s"] = 2.0 * np.arange(n) + 1  # a trend, which the confounds span
        if run == 1:
            del x["q"]
        c = {f"motion {i}": rng.normal(size=n) for i in range(run)}
        design += [(run, t, k, float(v[t]), False) for k, v in x.items() for t in range(n)] + [(run, t, k, float(v[t]), True) for k, v in c.items() for t in range(n)]
        rows = np.zeros((n, 2 + 3 * 4))
        rows[:, 0], rows[:, 1] = x["p"], x.get("q", np.zeros(n))
        rows[:, 2 + 4 * run : 4 + 4 * run] = np.column_stack([np.ones(n), np.arange(n)])
        for i, v in enumerate(c.values()):
            rows[:, 4 + 4 * run + i] = v
        X.append(rows)
        for key, y in Y.items():
            v = x["p"] * 0.5 + rng.normal(size=n) + offset + run
            y.append(v)
            series += [(run, key, t, float(v[t])) for t in range(n)]
    return design, series, X, Y


def frames(spark, design, series):
    d = spark.createDataFrame(design, "run int, t int, predictor string, value double, confound boolean")
    return G.with_trends(d, ["run"], "t", F.lit(1)), spark.createDataFrame(series, "run int, key string, t int, y double")


NAMES = G.Names(["run"], ["key"], "t", ["p", "q", "s"])


def fitted(X, y, c):
    b = np.linalg.pinv(X) @ y
    rank = np.linalg.matrix_rank(X)
    se = np.sqrt(((y - X @ b) ** 2).sum() / (len(y) - rank) * (c @ np.linalg.pinv(X.T @ X) @ c))
    return float(c @ b), float(se), float(len(y) - rank)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_fixed_effects_equal_the_stacked_model(spark, offset):
    design, series, X, Y = data(offset)
    d, s = frames(spark, design, series)
    got = {(r.key, r.predictor): (r.beta, r.se, r.df) for r in G.fixed_effects(s, d, NAMES, "y", {"p - q": [1, -1, 0], "s too": [1, 0, 1]}).collect()}
    assert {k[1] for k in got} == {"p", "q", "p - q"}  # s and what needs it are left out
    for key, y in Y.items():
        for name, c in (("p", [1, 0]), ("q", [0, 1]), ("p - q", [1, -1])):
            want = fitted(np.vstack(X), np.concatenate(y), np.array([*c, *[0] * 12], float))
            assert got[key, name] == pytest.approx(want, rel=1e-6)


def test_runs_and_their_weighted_means(spark):
    design, series, X, Y = data()
    d, s = frames(spark, design, series)
    runs = G.run_effects(s, d, NAMES, "y")
    got = {(r.run, r.key, r.predictor): r for r in runs.collect()}
    assert (1, "a", "q") not in got
    both = {(r.key, r.predictor): r for r in G.random_effects(runs, [], ["key"]).collect()}
    for key, y in Y.items():
        weights, betas = [], []
        for run in (0, 2):
            x = X[run][:, np.any(X[run] != 0, axis=0)]
            c = np.eye(x.shape[1])[1]
            assert (got[run, key, "q"].beta, got[run, key, "q"].se) == pytest.approx(fitted(x, y[run], c)[:2], rel=1e-8)
            weights.append(1 / np.linalg.inv(x.T @ x)[1, 1])
            betas.append(got[run, key, "q"].beta)
        assert both[key, "q"].beta == pytest.approx(np.average(betas, weights=weights)) and both[key, "q"].runs == 2


@pytest.mark.parametrize("order", [1, 2])
def test_autoregressive_errors_whiten_both_sides(spark, order):
    design, series, X, Y = data()
    d, s = frames(spark, design, series)
    got = {(r.run, r.key): r for r in G.run_effects(s, d, NAMES, "y", order=order).where("predictor = 'p'").collect()}
    assert len(got) == 6
    for (run, key), r in got.items():
        x, y = X[run][:, np.any(X[run] != 0, axis=0)], Y[key][run]
        e = y - x @ np.linalg.pinv(x) @ y
        r1, r2 = np.corrcoef(e[1:], e[:-1])[0, 1], np.corrcoef(e[2:], e[:-2])[0, 1]
        a = [r1] if order == 1 else [r1 * (1 - r2) / (1 - r1**2), (r2 - r1**2) / (1 - r1**2)]
        a = [round(20 * v) / 20 for v in a]
        assert [r[f"a{i + 1}"] for i in range(order)] == pytest.approx(a)
        white = lambda z: z[order:] - sum(a[i] * z[order - 1 - i : len(z) - 1 - i] for i in range(order))  # noqa: E731, B023
        assert (r.beta, r.se) == pytest.approx(fitted(white(x), white(y), np.eye(x.shape[1])[0])[:2], rel=1e-8)


def test_incomplete_series_and_empty_tables(spark):
    design, series, _, _ = data()
    d, s = frames(spark, design, series[1:] + [(0, "c", t, None) for t in range(40)])
    keys = {(r.run, r.key) for r in G.run_effects(s, d, NAMES, "y").collect()}
    assert (0, "a") not in keys and (0, "c") in keys and len(keys) == 6
    assert G.fixed_effects(s.limit(0), d, NAMES, "y").collect() == []
