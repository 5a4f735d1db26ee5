"""Robust fits: bisquare means and regressions, and exact order statistics of groups.

A group of up to ``small`` rows is fitted by one kernel in one task.  A larger
one never meets in a task: its fit is rounds of Spark aggregates that all open
groups take together and settled ones leave.  A round needs the median of the
absolute residuals, found exactly by narrowing histograms, and weighted sums of
products, summed before the shuffle; what passes from round to round is one row
a group, in a written table.  Both ways give the same fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import good
from ..store import written
from .windows import joined_groups

#: Rows of a group that may meet in one task; values of a group that are sorted at last; bins of a histogram; rounds.
SMALL, GATHER, BINS, ROUNDS = 200_000, 10_000, 1024, 50
#: Bisquare tuning, and the median absolute deviation of a standard normal.
TUNE, NORMAL = 4.685, 0.6745


def _without(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    g = groups.select(*[F.col(c).alias(f"_by_{c}") for c in by])
    on = F.lit(True)
    for c in by:
        on &= df[c].eqNullSafe(g[f"_by_{c}"])
    return df.join(g, on, "left_anti")


def order_statistics(rows: DataFrame, by: list[str], x: str, ranks: DataFrame, gather: int = GATHER) -> DataFrame:
    """by, v1 and v2: the values of rank ``k1`` and ``k2`` (columns of ``ranks``, one row a group, from 0; k2 is k1 or the next) among a group's finite values.

    A histogram between a group's bounds shows the bin that holds k1; its least
    and greatest values are the next bounds, and the least value behind it is
    kept.  Bins are monotone in the value, so nothing is lost to rounding, and
    the least and the greatest value never share one, so every pass leaves a
    value out.  Groups with few values between their bounds wait until all have
    few; these are sorted.
    """
    d = rows.select(*by, F.col(x).cast("double").alias("_x"))
    ends = d.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_in"))
    state = joined_groups(ends, ranks.select(*by, "k1", "k2"), by).withColumn("_below", F.lit(0).cast("long")).withColumn("_next", F.lit(None).cast("double"))
    state = written(state, "bounds")
    closed = (F.col("_in") <= gather) | (F.col("_lo") == F.col("_hi"))
    columns = [*by, "_lo", "_hi", "_in", "k1", "k2", "_below", "_next"]
    while not (still := state.where(~closed)).isEmpty():
        # halves, so that no difference overflows; a range too small for halves has two bins
        share = F.coalesce(F.try_divide(F.col("_x") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2), (F.col("_x") > F.col("_lo")).cast("double"))
        b = F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("_b")
        counts = joined_groups(d, still.select(*by, "_lo", "_hi"), by).where(F.col("_x").between(F.col("_lo"), F.col("_hi"))).groupBy(*by, b).agg(F.count("*").alias("_c"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
        in_order = Window.partitionBy(*by).orderBy("_b")
        before = F.coalesce(F.sum("_c").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_before", before).withColumn("_after", F.lead("_mn").over(in_order))
        found = joined_groups(counts, still.select(*by, "k1", "k2", "_below", "_next"), by)
        rank = F.col("k1") - F.col("_below")
        hit = found.where((F.col("_before") <= rank) & (F.col("_before") + F.col("_c") > rank))
        new = hit.select(*by, F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"), F.col("_c").alias("_in"), "k1", "k2", (F.col("_below") + F.col("_before")).alias("_below"), F.coalesce("_after", "_next").alias("_next"))
        state = written(state.where(closed).select(columns).unionByName(new), "bounds")
    inside = joined_groups(d, state.where("_lo < _hi"), by).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    lists = inside.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias("_s"), *[F.first(c).alias(c) for c in ("k1", "k2", "_below", "_next")])
    at = lambda k: F.get("_s", (F.col(k) - F.col("_below")).cast("int"))
    same = state.where("_lo = _hi").select(*by, F.col("_lo").alias("v1"), F.when(F.col("k2") - F.col("_below") < F.col("_in"), F.col("_lo")).otherwise(F.col("_next")).alias("v2"))
    return lists.select(*by, at("k1").alias("v1"), F.coalesce(at("k2"), "_next").alias("v2")).unionByName(same)


def medians(rows: DataFrame, by: list[str], x: str, gather: int = GATHER) -> DataFrame:
    """by, the exact median of each group's finite values and their number n; a group of any size."""
    d = rows.select(*by, good(F.col(x).cast("double")).alias("_v")).where("_v is not null")
    n = written(d.groupBy(*by).agg(F.count("*").alias("n")), "sizes")
    ranks = n.select(*by, F.expr("(n - 1) div 2").alias("k1"), F.expr("n div 2").alias("k2"))
    return joined_groups(order_statistics(d, by, "_v", ranks, gather).select(*by, ((F.col("v1") / 2 + F.col("v2") / 2)).alias("median")), n, by)


def _half(a: Column, b: Column) -> Column:
    return (a + b) / 2 / NORMAL


def _weight(residual: Column, scale: Column) -> Column:
    u = residual / (TUNE * scale)
    rest = F.greatest(1 - u * u, F.lit(0.0))
    return rest * rest


def _bisquare_mean(x: np.ndarray, tune: float = TUNE, most: int = ROUNDS) -> float:
    x = x[np.isfinite(x)]
    if not x.size:
        return 0.0
    m = float(np.median(x))
    for _ in range(most):
        r = x - m
        scale = np.median(np.abs(r)) / NORMAL
        if scale == 0:
            return m
        w = np.clip(1 - (r / (tune * scale)) ** 2, 0, None) ** 2
        new = float((w * x).sum() / w.sum())
        if abs(new - m) < 1e-10 * max(1.0, abs(m)):
            return new
        m = new
    return m


def robust_mean(df: DataFrame, by: list[str], x: str, most: int = ROUNDS, small: int = SMALL, gather: int = GATHER) -> DataFrame:
    """by, a bisquare-weighted mean of each group's good values (0 without any) and their number n; groups of more than ``small`` values take Spark rounds."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "") + "robust_mean double, n long"

    def run(key, pdf):
        v = pdf["_x"].to_numpy(float)
        return pd.DataFrame([[*key, _bisquare_mean(v, most=most), int(np.isfinite(v).sum())]], columns=[*by, "robust_mean", "n"])

    d = df.select(*by, F.col(x).cast("double").alias("_x"))
    sizes = written(d.groupBy(*by).agg(F.count(good("_x")).alias("n")).where(F.col("n") > small), "large")
    if sizes.isEmpty():
        return d.groupBy(*by).applyInPandas(run, schema)
    few = _without(d, sizes, by).groupBy(*by).applyInPandas(run, schema)
    rows = written(joined_groups(d.select(*by, good("_x").alias("_x")).where("_x is not null"), sizes.select(*by), by), "rows")
    ranks = sizes.select(*by, F.expr("(n - 1) div 2").alias("k1"), F.expr("n div 2").alias("k2"))
    state = order_statistics(rows, by, "_x", ranks, gather).select(*by, ((F.col("v1") + F.col("v2")) / 2).alias("m"), F.lit(True).alias("open"))
    for _ in range(most):
        state = written(state, "means")
        still = state.where("open")
        if still.isEmpty():
            break
        d = joined_groups(rows, still.select(*by, "m"), by).withColumn("_r", F.col("_x") - F.col("m"))
        mad = order_statistics(d.select(*by, F.abs("_r").alias("_a")), by, "_a", joined_groups(still.select(*by), ranks, by), gather)
        mad = written(mad.select(*by, _half(F.col("v1"), F.col("v2")).alias("scale")), "scales")
        w = _weight(F.col("_r"), F.col("scale"))
        new = joined_groups(d, mad, by).where("scale > 0").groupBy(*by).agg((F.first("m") + F.try_divide(F.sum(w * F.col("_r")), F.sum(w))).alias("_new"))
        settled = F.abs(F.col("_new") - F.col("m")) < 1e-10 * F.greatest(F.lit(1.0), F.abs("m"))
        moved = joined_groups(new, still.select(*by, "m"), by).select(*by, F.col("_new").alias("m"), (~settled).alias("open"))
        constant = joined_groups(mad.where("scale = 0").select(*by), still.select(*by, "m"), by).select(*by, "m", F.lit(False).alias("open"))
        state = state.where("not open").unionByName(moved).unionByName(constant)
    return few.unionByName(joined_groups(state.select(*by, F.col("m").alias("robust_mean")), sizes, by).select(*by, "robust_mean", "n"))


def _kernel(X: np.ndarray, v: np.ndarray, tune: float, most: int) -> tuple[list, float, float, int]:
    """betas, scale, mean weight and n of one group."""
    ok = np.isfinite(v) & np.isfinite(X).all(axis=1)
    X, v = X[ok], v[ok]
    n, p = X.shape
    if n <= p:
        return [0.0] * p, 0.0, 0.0, n
    q = np.linalg.qr(X)[0]
    lever = np.sqrt(1 - np.minimum(0.9999, (q * q).sum(axis=1)))
    b = np.linalg.lstsq(X, v, rcond=None)[0]
    w = np.ones(n)
    scale = 0.0
    for _ in range(most):
        res = (v - X @ b) / lever
        scale = np.sort(np.abs(res))[p:]
        scale = float(np.median(scale)) / NORMAL if scale.size else 0.0
        if scale < 1e-12 * max(1.0, float(np.std(v))):
            break
        w = np.clip(1 - (res / (tune * scale)) ** 2, 0, None) ** 2
        s = np.sqrt(w)[:, None]
        new = np.linalg.lstsq(X * s, v * s[:, 0], rcond=None)[0]
        done = np.all(np.abs(new - b) <= 1e-8 * np.maximum(np.abs(new), np.abs(b)))
        b = new
        if done:
            break
    return b.tolist(), scale, float(w.mean()), n


def robust_regression(df: DataFrame, by: list[str], y: str, xs: list[str], tune: float = TUNE, most: int = ROUNDS, small: int = SMALL, gather: int = GATHER) -> DataFrame:
    """Bisquare iteratively reweighted least squares of each group: by, betas (intercept last), scale, mean weight and n; groups of more than ``small`` rows take Spark rounds."""
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "")
    schema = keys + "betas array<double>, scale double, mean_weight double, n long"
    names = [f"_x{i}" for i in range(len(xs))]

    def fit(key, pdf):
        X = np.column_stack([pdf[c].to_numpy(float) for c in names] + [np.ones(len(pdf))])
        return pd.DataFrame([[*key, *_kernel(X, pdf["_y"].to_numpy(float), tune, most)]], columns=[*by, "betas", "scale", "mean_weight", "n"])

    d = df.select(*by, F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(c) for x, c in zip(xs, names, strict=True)])
    finite = F.lit(True)
    for c in ("_y", *names):
        finite &= good(c).isNotNull()
    sizes = written(d.groupBy(*by).agg(F.count_if(finite).alias("n")).where(F.col("n") > max(small, len(xs) + 1)), "large")
    if sizes.isEmpty():
        return d.groupBy(*by).applyInPandas(fit, schema)
    few = _without(d, sizes, by).groupBy(*by).applyInPandas(fit, schema)
    return few.unionByName(_rounds(joined_groups(d.where(finite), sizes.select(*by), by), sizes, by, keys, len(xs), tune, most, gather))


def _rounds(rows: DataFrame, sizes: DataFrame, by: list[str], keys: str, k: int, tune: float, most: int, gather: int) -> DataFrame:
    p = k + 1
    centre = written(rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_y").alias("my"), F.stddev_pop("_y").alias("sd"), *[F.avg(f"_x{i}").alias(f"m{i}") for i in range(k)]), "centres")
    centred = joined_groups(rows, centre.select(*by, "my", *[f"m{i}" for i in range(k)]), by).select(*by, (F.col("_y") - F.col("my")).alias("_y"), *[(F.col(f"_x{i}") - F.col(f"m{i}")).alias(f"_x{i}") for i in range(k)])
    columns = [*[F.col(f"_x{i}") for i in range(k)], F.lit(1.0)]

    def products(d: DataFrame, w: Column) -> DataFrame:
        """Of each group: w, and the weighted products a (flat) and b, about the centres."""
        upper = [(i, j) for i in range(p) for j in range(i, p)]
        s = d.groupBy(*by).agg(F.sum(w).alias("w"), *[F.sum(w * columns[i] * columns[j]).alias(f"a{i}_{j}") for i, j in upper], *[F.sum(w * columns[i] * F.col("_y")).alias(f"b{i}") for i in range(p)])
        return s.select(*by, "w", F.array(*[f"a{min(i, j)}_{max(i, j)}" for i in range(p) for j in range(p)]).alias("a"), F.array(*[f"b{i}" for i in range(p)]).alias("b"))

    def solve(s: DataFrame) -> DataFrame:
        def run(it):
            for g in it:
                if len(g):
                    inv = np.linalg.pinv(np.stack(g["a"].to_numpy()).reshape(-1, p, p), hermitian=True)
                    out = g[[*by, "w"]].copy()
                    out["inv"], out["new"] = list(inv.reshape(-1, p * p)), list(np.einsum("gij,gj->gi", inv, np.stack(g["b"].to_numpy())))
                    yield out

        return s.mapInPandas(run, keys + "w double, inv array<double>, new array<double>")

    first = written(solve(products(centred, F.lit(1.0))), "first")
    h = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            h = h + F.get("inv", i * p + j) * columns[i] * columns[j]
    d = written(joined_groups(centred, first.select(*by, "inv"), by).withColumn("_l", F.sqrt(1 - F.least(F.lit(0.9999), h))).drop("inv"), "rows")

    def raw(b: str) -> Column:
        """Betas about the centres as those of the data, intercept last."""
        shift = F.col("my") + F.get(b, k)
        for i in range(k):
            shift = shift - F.get(b, i) * F.col(f"m{i}")
        return F.array(*[F.get(b, i) for i in range(k)], shift)

    ranks = centre.select(*by, (p + F.expr(f"(n - {p} - 1) div 2")).alias("k1"), (p + F.expr(f"(n - {p}) div 2")).alias("k2"))
    state = first.select(*by, F.col("new").alias("beta"), F.lit(0.0).alias("scale"), F.lit(1.0).alias("mean_weight"), F.lit(True).alias("open"))
    kept = [*by, "beta", "scale", "mean_weight", "open"]
    for _ in range(most):
        state = written(state, "fits")
        still = state.where("open")
        if still.isEmpty():
            break
        fitted = F.lit(0.0)
        for i in range(p):
            fitted = fitted + F.get("beta", i) * columns[i]
        r = joined_groups(d, still.select(*by, "beta"), by).withColumn("_r", (F.col("_y") - fitted) / F.col("_l"))
        found = order_statistics(r.select(*by, F.abs("_r").alias("_a")), by, "_a", joined_groups(still.select(*by), ranks, by), gather)
        found = joined_groups(found.select(*by, _half(F.col("v1"), F.col("v2")).alias("_s")), centre, by)
        found = written(found.withColumn("_flat", F.col("_s") < 1e-12 * F.greatest(F.lit(1.0), F.col("sd"))), "scales")
        u = F.col("_r") / (tune * F.col("_s"))
        rest = F.greatest(1 - u * u, F.lit(0.0))
        new = solve(products(joined_groups(r, found.where("not _flat").select(*by, "_s"), by), rest * rest))
        both = joined_groups(joined_groups(new, still.select(*by, "beta"), by), found.drop("_flat"), by).withColumn("_old", raw("beta")).withColumn("_now", raw("new"))
        settled = F.forall(F.zip_with("_now", "_old", lambda a, b: F.abs(a - b) <= 1e-8 * F.greatest(F.abs(a), F.abs(b))), lambda v: v)
        moved = both.select(*by, F.col("new").alias("beta"), F.col("_s").alias("scale"), (F.col("w") / F.col("n")).alias("mean_weight"), (~settled).alias("open"))
        flat = joined_groups(found.where("_flat").select(*by, "_s"), still.drop("scale", "open"), by).select(*by, "beta", F.col("_s").alias("scale"), "mean_weight", F.lit(False).alias("open"))
        state = state.where("not open").select(kept).unionByName(moved).unionByName(flat)
    out = joined_groups(state, centre, by)
    return out.select(*by, raw("beta").alias("betas"), "scale", "mean_weight", "n")
