"""The general linear model over runs of keyed series: designs assembled by name, fixed and random effects, autoregressive errors.

A design is a long table: run, time, predictor, value and whether the predictor
is a confound; runs may have different predictors.  A series is a long table
run, key, time, value with a value at each time of its run's design.

What differs between runs is settled in the designs, which are small, before
the series are touched.  Each run's predictors of interest are cleared of its
own confounds and constant (the Schur complement of its product matrix), after
which runs with any confounds have sums of the same form.  The series then give
one row of sums for each run and key by partial aggregation: their products
with the cleared predictors, and with an orthonormal basis of the confounds.
Sums of runs add up to the fixed-effects model, or are solved run by run and
combined by weight.  Autoregressive errors whiten series and designs by the
residuals' lag coefficients on a grid of 0.05 and pass the same way again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import good
from ..store import written


class Names:
    """Columns of a model: what identifies a run (``run``) and a series in it (``key``), the time, and the predictors of interest by name."""

    def __init__(self, run: list[str], key: list[str], time: str, predictors: list[str]):
        self.run, self.key, self.time, self.predictors = run, key, time, predictors


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def stacked(designs: list[DataFrame]) -> DataFrame:
    """Designs of single runs as one, predictors by name."""
    out = designs[0]
    for d in designs[1:]:
        out = out.unionByName(d)
    return out


def with_trends(design: DataFrame, run: list[str], time: str, degree: Column) -> DataFrame:
    """The design with powers of time as confounds, up to ``degree`` (a column of the run, 0 for none)."""
    times = design.groupBy(*run, time).agg(F.max(degree).alias("_d")).where("_d > 0")
    power = times.select(*run, time, F.explode(F.sequence(F.lit(1), F.col("_d").cast("int"))).alias("_p"))
    trend = power.select(*run, time, F.concat(F.lit("trend "), F.col("_p")).alias("predictor"), F.pow(F.col(time).cast("double"), F.col("_p")).alias("value"), F.lit(True).alias("confound"))
    return design.select(*run, time, "predictor", F.col("value").cast("double").alias("value"), "confound").unionByName(trend)


def _basis(c: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of ``c``."""
    size = np.linalg.norm(c, axis=0)
    c = c[:, size > 0] / size[size > 0]
    if not c.shape[1]:
        return c
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    return u[:, s > 1e-9 * s[0]]


def _matrices(pdf: pd.DataFrame, time: str, predictors: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, predictors of interest (absent ones 0) and confounds of one run."""
    wide = pdf.pivot_table(index=time, columns=["confound", "predictor"], values="value", aggfunc="sum", fill_value=0.0).sort_index()
    x = np.column_stack([wide[False, p].to_numpy(float) if (False, p) in wide.columns else np.zeros(len(wide)) for p in predictors])
    c = np.column_stack([np.zeros((len(wide), 0)), *(wide[k].to_numpy(float) for k in wide.columns if k[0])])
    return wide.index.to_numpy(), x, c


def prepared(design: DataFrame, names: Names, lags: list[str] = ()) -> tuple[DataFrame, int]:
    """For each run and time its cleared predictors ``x`` and confounds' basis ``q``, with (once a run) the products ``s`` of x, the number of times and of confounds; and the most confounds of a run.

    ``lags`` are columns of autoregressive coefficients that also tell runs
    apart: predictors and confounds are whitened by them, and as many first
    times fall away.  A predictor that the confounds span counts as absent.
    """
    keys, p = [*names.run, *lags], len(names.predictors)
    of_run = design.where("confound").groupBy(*names.run).agg(F.count_distinct("predictor").alias("c"))
    most = of_run.agg(F.max("c")).first()[0] or 0

    def run(key, pdf):
        time, x, c = _matrices(pdf, names.time, names.predictors)
        a, m = key[len(names.run) :], len(lags)
        if m:
            x, c = (z[m:] - sum(a[i] * z[m - 1 - i : len(z) - 1 - i] for i in range(m)) for z in (x, c))
            time = time[m:]
        before = np.linalg.norm(x, axis=0)
        x, q = x - x.mean(axis=0), _basis(c - c.mean(axis=0))
        for _ in range(2):
            x = x - q @ (q.T @ x)
        x[:, np.linalg.norm(x, axis=0) <= 1e-9 * before] = 0.0
        out = pd.DataFrame({names.time: time, "x": list(x), "q": list(np.pad(q, ((0, 0), (0, most - q.shape[1]))))})
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        out["s"] = pd.Series([(x.T @ x).ravel().tolist(), *[None] * (len(out) - 1)][: len(out)], dtype=object)
        out["times"], out["confounds"] = len(time), q.shape[1]
        return out[[*keys, names.time, "x", "q", "s", "times", "confounds"]]

    schema = f"{_types(design, keys)}, {_types(design, [names.time])}, x array<double>, q array<double>, s array<double>, times long, confounds long"
    assert p, "a model needs a predictor"
    return written(design.groupBy(*keys).applyInPandas(run, schema), "design"), most


def sums(series: DataFrame, design: DataFrame, most: int, names: Names, y: str, lags: list[str] = ()) -> DataFrame:
    """run, key, n, rss (about constant and confounds), b and, of the design, s, times and confounds.

    A value that is null, NaN or infinite counts as 0.  Series without a value
    at each time of the run's design are left out.
    """
    keys, p = [*names.run, *lags], len(names.predictors)
    value = F.coalesce(good(F.col(y).cast("double")), F.lit(0.0))
    d = series.select(*keys, *names.key, names.time, value.alias("_y")).join(design.select(*keys, names.time, "x", "q"), [*keys, names.time])
    n = F.count("*")
    parts = [(F.covar_pop(F.get("x", i), "_y") * n).alias(f"b{i}") for i in range(p)] + [(F.covar_pop(F.get("q", i), "_y") * n).alias(f"q{i}") for i in range(most)]
    s = d.groupBy(*keys, *names.key).agg(n.alias("n"), F.avg("_y").alias("mean"), (F.var_pop("_y") * n).alias("v"), *parts)
    rss = F.col("v")
    for i in range(most):
        rss = rss - F.col(f"q{i}") * F.col(f"q{i}")
    s = s.select(*keys, *names.key, "n", "mean", F.greatest(rss, F.lit(0.0)).alias("rss"), F.array(*[F.col(f"b{i}") for i in range(p)]).alias("b"), F.array(*[F.col(f"q{i}") for i in range(most)]).cast("array<double>").alias("qy"))
    return s.join(design.where("s is not null").select(*keys, "s", "times", "confounds"), keys).where("n = times").withColumn("used", F.col("confounds") + 1)


def together(run_sums: DataFrame, names: Names) -> DataFrame:
    """Sums of runs as those of each key: the fixed-effects model with every run's own confounds."""
    p = len(names.predictors)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    s = run_sums.groupBy(*names.key).agg(
        F.sum("n").alias("n"), F.sum("used").alias("used"), F.sum("rss").alias("rss"),
        *[F.sum(F.get("b", i)).alias(f"b{i}") for i in range(p)], *[F.sum(F.get("s", i * p + j)).alias(f"s{i}_{j}") for i, j in upper],
    )
    return s.select(*names.key, "n", "used", "rss", F.array(*[f"b{i}" for i in range(p)]).alias("b"), F.array(*[f"s{min(i, j)}_{max(i, j)}" for i in range(p) for j in range(p)]).alias("s"))


def solved(run_sums: DataFrame, by: list[str], names: Names, contrasts: dict[str, list[float]] | None = None) -> DataFrame:
    """by, predictor (or contrast), beta, se, t, df and weight (the inverse of its place in the inverse product matrix), for what the design has; batches of rows are solved at once.

    A contrast with a part that the design lacks is left out.  t is 0 where it can't be told.
    """
    p = len(names.predictors)
    every = {n: np.eye(p)[i] for i, n in enumerate(names.predictors)} | {k: np.array(v, float) for k, v in (contrasts or {}).items()}
    labels, C = list(every), np.array(list(every.values()))

    def run(it):
        for g in it:
            if not len(g):
                continue
            s, b = np.stack(g["s"].to_numpy()).reshape(-1, p, p), np.stack(g["b"].to_numpy())
            inv = np.linalg.pinv(s, rcond=1e-12, hermitian=True)
            beta = np.einsum("gij,gj->gi", inv, b)
            rss = np.maximum(g["rss"].to_numpy(float) - (beta * b).sum(axis=1), 0.0)
            present = np.diagonal(s, axis1=1, axis2=2) > 0
            df = g["n"].to_numpy(float) - g["used"].to_numpy(float) - present.sum(axis=1)
            var = np.einsum("ci,gij,cj->gc", C, inv, C)
            with np.errstate(divide="ignore", invalid="ignore"):
                se = np.where(df > 0, np.sqrt(rss / df), np.nan)[:, None] * np.sqrt(var)
                value = beta @ C.T
                t, weight = value / se, 1 / var
            there = ~((C != 0)[None, :, :] & ~present[:, None, :]).any(axis=2)
            row, col = np.nonzero(there)
            out = g[by].iloc[row].reset_index(drop=True)
            out["predictor"], out["beta"], out["se"] = np.array(labels, object)[col], value[row, col], se[row, col]
            out["t"], out["df"], out["weight"] = np.where(np.isfinite(t), t, 0.0)[row, col], df[row], np.where(np.isfinite(weight), weight, 0.0)[row, col]
            yield out

    return run_sums.select(*by, "n", "used", "rss", "b", "s").mapInPandas(run, f"{_types(run_sums, by)}, predictor string, beta double, se double, t double, df double, weight double")


def fixed_effects(series: DataFrame, design: DataFrame, names: Names, y: str, contrasts: dict[str, list[float]] | None = None, order: int = 0) -> DataFrame:
    """One model over all runs: key, predictor, beta, se, t and df.  ``order`` 1 or 2 whitens every run's series by its own residuals."""
    s = sums(series, *prepared(design, names), names, y) if not order else whitened(series, design, names, y, order)
    return solved(together(s, names), names.key, names, contrasts).drop("weight")


def run_effects(series: DataFrame, design: DataFrame, names: Names, y: str, contrasts: dict[str, list[float]] | None = None, order: int = 0) -> DataFrame:
    """A model for each run: run, key, [the lag coefficients,] predictor, beta, se, t, df and weight."""
    if not order:
        s, by = sums(series, *prepared(design, names), names, y), [*names.run, *names.key]
    else:
        s, by = whitened(series, design, names, y, order), [*names.run, *names.key, *LAGS[:order]]
    return solved(s, by, names, contrasts)


def random_effects(estimates: DataFrame, subject: list[str], key: list[str], volumes: str | None = None) -> DataFrame:
    """Run estimates as one of each subject, key and predictor: the mean by weight (or by ``volumes``, a column), over the runs that have the predictor; 0 where no estimate is good."""
    b = good("beta")
    w = F.when(b.isNotNull() & (F.col("weight") != 0), F.col(volumes) if volumes else good("weight"))
    beta = F.coalesce(good(F.try_divide(F.sum(w * b), F.sum(w))), F.lit(0.0))
    return estimates.groupBy(*subject, *key, "predictor").agg(beta.alias("beta"), F.count(w).alias("runs"))


LAGS = ["a1", "a2"]


def lag_coefficients(series: DataFrame, design: DataFrame, most: int, names: Names, y: str, order: int) -> DataFrame:
    """run, key and a1 [and a2] of each series' least-squares residuals, rounded to 0.05: the lag-1 correlation, or for order 2 the Yule-Walker coefficients; 0 where they can't be told."""
    p = len(names.predictors)
    by = [*names.run, *names.key]
    fit = sums(series, design, most, names, y)
    wide = fit.select(*by, "mean", "qy", F.col("s"), F.col("b"))

    def run(it):
        for g in it:
            if len(g):
                inv = np.linalg.pinv(np.stack(g["s"].to_numpy()).reshape(-1, p, p), rcond=1e-12, hermitian=True)
                out = g[[*by, "mean", "qy"]].copy()
                out["beta"] = list(np.einsum("gij,gj->gi", inv, np.stack(g["b"].to_numpy())))
                yield out

    betas = wide.mapInPandas(run, f"{_types(fit, by)}, mean double, qy array<double>, beta array<double>")
    d = series.select(*by, names.time, F.coalesce(good(F.col(y).cast("double")), F.lit(0.0)).alias("_y")).join(design.select(*names.run, names.time, "x", "q"), [*names.run, names.time]).join(betas, by)
    e = F.col("_y") - F.col("mean")
    for c, w, k in (("x", "beta", p), ("q", "qy", most)):
        for i in range(k):
            e = e - F.get(c, i) * F.get(w, i)
    order_by = Window.partitionBy(*by).orderBy(names.time)
    d = d.select(*by, names.time, e.alias("_e")).withColumn("_1", F.lag("_e", 1).over(order_by)).withColumn("_2", F.lag("_e", 2).over(order_by))
    part = lambda c: F.coalesce(good(F.when(F.var_pop("_e") > 0, F.corr("_e", c))), F.lit(0.0))
    r = d.groupBy(*by).agg(part("_1").alias("_r1"), part("_2").alias("_r2"))
    grid = lambda c: F.round(20 * F.coalesce(good(c), F.lit(0.0))) / 20
    r1, r2 = F.col("_r1"), F.col("_r2")
    if order == 1:
        return r.select(*by, grid(r1).alias("a1"))
    return r.select(*by, grid(F.try_divide(r1 * (1 - r2), 1 - r1 * r1)).alias("a1"), grid(F.try_divide(r2 - r1 * r1, 1 - r1 * r1)).alias("a2"))


def whitened(series: DataFrame, design: DataFrame, names: Names, y: str, order: int) -> DataFrame:
    """``sums`` of series and designs whitened by each series' lag coefficients, which tell the rows of a run apart; the first ``order`` times fall away.

    Times are taken as equally spaced.  Designs are whitened once for each run
    and pair of coefficients that occurs.
    """
    lags = LAGS[:order]
    by = [*names.run, *names.key]
    series = written(series.select(*by, names.time, y), "series")  # read three times
    plain, most = prepared(design, names)
    a = written(lag_coefficients(series, plain, most, names, y, order), "lags")
    in_time = Window.partitionBy(*by).orderBy(names.time)
    value = F.coalesce(good(F.col(y).cast("double")), F.lit(0.0))
    d = series.select(*by, names.time, value.alias("_y"))
    d = d.select("*", *[F.lag("_y", i + 1).over(in_time).alias(f"_y{i}") for i in range(order)]).join(a, by).where(f"_y{order - 1} is not null")
    white = F.col("_y")
    for i, c in enumerate(lags):
        white = white - F.col(c) * F.col(f"_y{i}")
    designs = design.join(a.select(*names.run, *lags).distinct(), names.run)
    return sums(d.select(*by, *lags, names.time, white.alias("_w")), *prepared(designs, names, lags), names, "_w", lags)
