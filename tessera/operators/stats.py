"""Statistics: tests, linear models from normal equations, reliability, false-discovery thresholds.

Models are sums of products first: one partial aggregation per group, then
closed forms or a small matrix solve per group on the sums, never on the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PRIME, good


def one_sample_t(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """sqrt(n) mean / sd of good values; 0 if there are fewer than two or the sd is 0."""
    g = good(x)
    t = F.sqrt(F.count(g)) * F.try_divide(F.avg(g), F.stddev_samp(g))
    return df.groupBy(*by).agg(F.coalesce(good(t), F.lit(0.0)).alias("t"), F.count(g).alias("n"))


def welch(m1: Column, m2: Column, s1: Column, s2: Column, n1: Column, n2: Column) -> dict[str, Column]:
    """Two-sample t and its Welch degrees of freedom from means, sds and sizes; bad values give 0."""
    v1, v2 = s1 * s1 / n1, s2 * s2 / n2
    t = F.coalesce(good(F.try_divide(m1 - m2, F.sqrt(v1 + v2))), F.lit(0.0))
    df = F.try_divide((v1 + v2) * (v1 + v2), v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1))
    return {"t": t, "df": F.coalesce(good(df), F.lit(0.0))}


def two_sample_t(df: DataFrame, by: list[str], x: str, first: Column) -> DataFrame:
    """Welch's t between the rows of ``first`` and the others."""
    a, b = F.when(first, F.col(x)), F.when(~first, F.col(x))
    s = df.groupBy(*by).agg(F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.stddev_samp(a).alias("s1"), F.stddev_samp(b).alias("s2"), F.count(a).alias("n1"), F.count(b).alias("n2"))
    w = welch(*[F.col(c) for c in ("m1", "m2", "s1", "s2", "n1", "n2")])
    return s.select(*by, w["t"].alias("t"), w["df"].alias("df"), "n1", "n2")


def stouffer(z: str, weight: str | None = None) -> Column:
    """Aggregate: z scores as one; bad ones count as 0."""
    v = F.coalesce(good(z), F.lit(0.0))
    if weight is None:
        return F.sum(v) / F.sqrt(F.count("*"))
    return F.try_divide(F.sum(F.col(weight) * v), F.sqrt(F.sum(F.col(weight) * F.col(weight))))


def normal_equations(df: DataFrame, by: list[str], y: str, xs: list[str], weight: str | None = None) -> DataFrame:
    """n, the sum of weights, the means and the centred sums of products of the predictors and the response, per group.

    Products are taken about the group's means, so an offset of all values costs
    no digits: by Spark's own covariances, or with weights in a second pass.
    """
    cols = [*xs, y]
    ok = F.lit(True)
    for c in cols:
        ok &= F.col(c).isNotNull()
    d = df.where(ok)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if weight is None:
        n = F.count("*")
        means = [F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)]
        return d.groupBy(*by).agg(n.alias("n"), n.cast("double").alias("sw"), *means, *[(F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")) * n).alias(f"c_{i}_{j}") for i, j in pairs])
    from .windows import beside

    w = F.col(weight)
    d = beside(d.where(w.isNotNull()), by, **{f"_m{i}": F.sum(w * F.col(c)) / F.sum(w) for i, c in enumerate(cols)})
    away = [F.col(c) - F.col(f"_m{i}") for i, c in enumerate(cols)]
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), *[F.first(f"_m{i}").alias(f"m_{i}") for i in range(len(cols))], *[F.sum(w * away[i] * away[j]).alias(f"c_{i}_{j}") for i, j in pairs])


def merge_equations(sums: DataFrame, by: list[str]) -> DataFrame:
    """Equations of parts (runs, studies) as those of the whole: the parts' products and those of their means about the common one."""
    from .windows import beside

    k = sum(c.startswith("m_") for c in sums.columns)
    d = beside(sums, by, **{f"_g{i}": F.sum(F.col("sw") * F.col(f"m_{i}")) / F.sum("sw") for i in range(k)})
    away = [F.col(f"m_{i}") - F.col(f"_g{i}") for i in range(k)]
    products = [F.sum(F.col(f"c_{i}_{j}") + F.col("sw") * away[i] * away[j]).alias(f"c_{i}_{j}") for i in range(k) for j in range(i, k)]
    return d.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sw").alias("sw"), *[F.first(f"_g{i}").alias(f"m_{i}") for i in range(k)], *products)


def solve(sums: DataFrame, by: list[str], xs: list[str], contrast: list[float] | None = None) -> DataFrame:
    """by, betas (intercept last), se, n, df, rss and, with a contrast, its t; a batch of groups is solved at once."""
    p = len(xs)
    schema = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by) + ", betas array<double>, se double, n long, df double, rss double, t double"
    c = np.array(contrast if contrast is not None else [0.0] * (p + 1), float)

    def run(it):
        for b in it:
            m = np.empty((len(b), p + 1, p + 1))
            for i in range(p + 1):
                for j in range(i, p + 1):
                    m[:, i, j] = m[:, j, i] = b[f"c_{i}_{j}"]
            mean = b[[f"m_{i}" for i in range(p + 1)]].to_numpy(float)
            inv = np.linalg.pinv(m[:, :p, :p], hermitian=True)
            slope = np.einsum("gij,gj->gi", inv, m[:, :p, p])
            beta = np.column_stack([slope, mean[:, p] - (slope * mean[:, :p]).sum(axis=1)])
            rss = np.maximum(m[:, p, p] - (slope * m[:, :p, p]).sum(axis=1), 0.0)
            df = b["n"].to_numpy(float) - p - 1
            u = c[:p] - c[p] * mean[:, :p]  # the contrast about the means, where slopes and mean are uncorrelated
            with np.errstate(divide="ignore", invalid="ignore"):
                se = np.where(df > 0, np.sqrt(rss / df), np.nan)
                t = (beta @ c) / (se * np.sqrt(np.einsum("gi,gij,gj->g", u, inv, u) + c[p] ** 2 / b["sw"].to_numpy(float)))
            out = b[by].copy()
            out["betas"], out["se"], out["n"], out["df"], out["rss"] = list(beta), se, b["n"], df, rss
            out["t"] = np.where(np.isfinite(t), t, 0.0)
            yield out

    return sums.mapInPandas(run, schema)


def simple_regression(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Slope, intercept, residual sd and t of the slope, wholly from built-in aggregates."""
    s = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_count(y, x).alias("n"))
    rss = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    se = F.sqrt(F.try_divide(rss, F.col("n") - 2))
    return s.select(*by, "slope", "intercept", se.alias("se"), F.coalesce(good(F.try_divide(F.col("slope") * F.sqrt("sxx"), se)), F.lit(0.0)).alias("t"), "n")


def model_comparison(full: DataFrame, reduced: DataFrame, by: list[str]) -> DataFrame:
    """F of a full model against a nested one, from both models' rss and df."""
    r = reduced.select(*by, F.col("rss").alias("_r"), F.col("df").alias("_d"))
    num = F.try_divide(F.col("_r") - F.col("rss"), F.col("_d") - F.col("df"))
    return full.join(r, by).select(*by, F.coalesce(good(F.try_divide(num, F.try_divide(F.col("rss"), F.col("df")))), F.lit(0.0)).alias("f"), (F.col("_d") - F.col("df")).alias("df1"), F.col("df").alias("df2"))


def partial_correlation(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    s = df.groupBy(*by).agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"), F.count("*").alias("n"))
    r = F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))))
    return s.select(*by, r.alias("r"), "n")


def dependent_correlation_t(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """t (n - 3) of the difference between corr(x, y) and corr(x, z), which share x."""
    s = df.groupBy(*by).agg(F.corr(x, y).alias("a"), F.corr(x, z).alias("b"), F.corr(y, z).alias("c"), F.count("*").alias("n"))
    a, b, c, n = F.col("a"), F.col("b"), F.col("c"), F.col("n")
    det = 1 - a * a - b * b - c * c + 2 * a * b * c
    mean = (a + b) / 2
    t = (a - b) * F.sqrt(F.try_divide((n - 1) * (1 + c), F.try_divide(2 * (n - 1), n - 3) * det + mean * mean * (1 - c) * (1 - c) * (1 - c)))
    return s.select(*by, t.alias("t"), (n - 3).alias("df"))


def combine_runs(betas: DataFrame, by: list[str], beta: str, weight: str) -> DataFrame:
    """Run estimates as one per subject: sum w b / sum w over good ones, 0 where there is none."""
    b = good(beta)
    w = F.when(b.isNotNull(), good(weight))
    return betas.groupBy(*by).agg(F.coalesce(good(F.try_divide(F.sum(w * b), F.sum(w))), F.lit(0.0)).alias("beta"))


def safe_contrast(betas: DataFrame, by: list[str], weight: str, beta: str) -> DataFrame:
    """Positive and negative weights are averaged apart over present values (good and not 0), then added."""
    b = F.coalesce(good(beta), F.lit(0.0))
    w = F.col(weight)

    def part(sign: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.when(sign, w * b)), F.abs(F.sum(F.when(sign & (b != 0), w)))), F.lit(0.0))

    return betas.groupBy(*by).agg((part(w > 0) + part(w < 0)).alias("contrast"))


def fdr_thresholds(df: DataFrame, by: list[str], p: str, levels: list[float], method: int = 2) -> DataFrame:
    """by, level and the p threshold.  Methods: 0 first crossing, 2 last crossing; 1 and 3 the same with the factor ln m + 0.5772.

    Equal p are counted first, so ranks come from a window over distinct p; for
    one family of tests those are ranked within buckets of p and the buckets'
    counts are added, so no single task orders all tests.
    """
    d = df.where(F.col(p).isNotNull())
    counts = d.groupBy(*by, p).agg(F.count("*").alias("c"))
    bucket = F.floor(F.col(p) * 4096).cast("int")
    counts = counts.withColumn("_b", bucket)
    sums = counts.groupBy(*by, "_b").agg(F.sum("c").alias("s"))
    part = Window.partitionBy(*by)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("s").over(before), F.lit(0))).withColumn("m", F.sum("s").over(part)).drop("s")
    inside = Window.partitionBy(*by, "_b").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    r = counts.join(sums, [*by, "_b"]).withColumn("i", F.col("_before") + F.sum("c").over(inside))
    factor = F.log("m") + 0.5772 if method % 2 else F.lit(1.0)
    r = r.withColumn("level", F.explode(F.array(*[F.lit(q) for q in levels])))
    ok = F.col(p) <= F.col("level") * F.col("i") / F.col("m") / factor
    if method >= 2:
        cut = F.max(F.when(ok, F.col(p)))
    else:  # the last p before the first failure
        bad = F.min(F.when(~ok, F.col(p)))
        r = r.join(r.groupBy(*by, "level").agg(bad.alias("_bad")), [*by, "level"])
        cut = F.max(F.when(ok & (F.col("_bad").isNull() | (F.col(p) < F.col("_bad"))), F.col(p)))
    return r.groupBy(*by, "level").agg(F.coalesce(cut, F.min(p) / 2.001).alias("threshold"))


def cohens_kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Agreement of two binary raters beyond chance; rows with a null are left out."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), F.count_if(F.col(a) == 1).alias("a1"), F.count_if(F.col(b) == 1).alias("b1"))
    n = F.col("n")
    chance = (F.col("a1") * F.col("b1") + (n - F.col("a1")) * (n - F.col("b1"))) / (n * n)
    return s.select(*by, F.try_divide(F.col("same") / n - chance, 1 - chance).alias("kappa"), "n")


def krippendorff_alpha(df: DataFrame, by: list[str], unit: str, value: str) -> DataFrame:
    """Nominal alpha over units with two ratings or more; nulls are left out.  Coincidences come from counts per unit and value, not from pairs."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, unit, value).agg(F.count("*").alias("c"))
    u = c.groupBy(*by, unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m > 1")
    agree = u.groupBy(*by).agg(F.sum(F.col("same") / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"))
    totals = c.join(u.select(*by, unit), [*by, unit], "left_semi").groupBy(*by, value).agg(F.sum("c").alias("k"))
    chance = totals.groupBy(*by).agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("e"))
    j = agree.join(chance, by) if by else agree.crossJoin(F.broadcast(chance))
    n = F.col("n")
    return j.select(*by, (1 - F.try_divide((n - F.col("o")) * (n - 1), n * (n - 1) - F.col("e"))).alias("alpha"), n.alias("n_values"))


def intraclass_correlation(df: DataFrame, target: str, rater: str, x: str) -> DataFrame:
    """icc1, icc2 and icc3 (single rater) and n_targets of a target by rater table, from two-way sums of squares about the grand mean.

    Several values of a target by one rater count as their mean; targets that
    not every rater has rated are left out; null where there is no variance.
    """
    cells = df.where(F.col(x).isNotNull()).groupBy(target, rater).agg(F.avg(x).alias("_x"))
    every = cells.select(rater).distinct().agg(F.count("*").alias("_k"))
    full = cells.groupBy(target).agg(F.count("*").alias("_c")).crossJoin(F.broadcast(every)).where("_c = _k").select(target, "_k")
    cells = cells.join(full, target)
    cells = cells.crossJoin(F.broadcast(cells.agg(F.avg("_x").alias("_g")))).select(target, rater, "_k", (F.col("_x") - F.col("_g")).alias("_x"))
    t = cells.groupBy(target).agg(F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("ss"), F.first("_k").alias("k"))
    rows = t.agg(F.count("*").alias("n"), F.first("k").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("st"), F.sum("ss").alias("ss"))
    cols = cells.groupBy(rater).agg(F.sum("_x").alias("s"), F.count("*").alias("c")).agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("sr"))
    r = rows.crossJoin(F.broadcast(cols))
    n, k, st, ss, sr = (F.col(c) for c in ("n", "k", "st", "ss", "sr"))  # sums about the grand mean need no correction
    bms, wms, jms = F.try_divide(st, n - 1), F.try_divide(ss - st, n * (k - 1)), F.try_divide(sr, k - 1)
    ems = F.try_divide(ss - st - sr, (n - 1) * (k - 1))
    icc = lambda a, b: F.try_divide(a, b)
    return r.select(icc(bms - wms, bms + (k - 1) * wms).alias("icc1"), icc(bms - ems, bms + (k - 1) * ems + k * (jms - ems) / n).alias("icc2"), icc(bms - ems, bms + (k - 1) * ems).alias("icc3"), n.alias("n_targets"))


def one_way_anova(df: DataFrame, by: list[str], factor: str, x: str) -> DataFrame:
    """F between the levels of a factor, from the levels' means and variances, so that an offset costs no digits."""
    from .windows import beside

    g = df.where(F.col(x).isNotNull()).groupBy(*by, factor).agg(F.count("*").alias("c"), F.avg(x).alias("m"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("v"))
    d = beside(g, by, _m=F.sum(F.col("c") * F.col("m")) / F.sum("c"))
    away = F.col("m") - F.col("_m")
    t = d.groupBy(*by).agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.sum(F.col("c") * away * away).alias("between"), F.sum(F.col("c") * F.col("v")).alias("within"))
    f = F.try_divide(F.try_divide(F.col("between"), F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return t.select(*by, f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def mahalanobis(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Squared Mahalanobis distance of every row in two columns; the five moments are one broadcast row."""
    m = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"), F.covar_samp(x, y).alias("_c"))
    d = df.crossJoin(F.broadcast(m))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    det = F.col("_vx") * F.col("_vy") - F.col("_c") * F.col("_c")
    return d.select(key, F.try_divide(F.col("_vy") * dx * dx - 2 * F.col("_c") * dx * dy + F.col("_vx") * dy * dy, det).alias("d2"))


def covariance_ellipse(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Centre, axis lengths (sd along them) and angle of the long axis."""
    s = df.groupBy(*by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("c"))
    half, diff = (F.col("vx") + F.col("vy")) / 2, (F.col("vx") - F.col("vy")) / 2
    root = F.sqrt(diff * diff + F.col("c") * F.col("c"))
    return s.select(*by, "cx", "cy", F.sqrt(half + root).alias("major"), F.sqrt(F.greatest(half - root, F.lit(0.0))).alias("minor"), (0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy"))).alias("angle"))


#: Distribution of a Poisson count of mean 1 up to 6; above it 7.
_POISSON = np.cumsum([np.exp(-1.0) / m for m in (1, 1, 2, 6, 24, 120, 720)])


def draws(key: np.ndarray, samples: np.ndarray, seed: int) -> np.ndarray:
    """(samples, rows) numbers from 0 to 1 that depend on a row's key, the sample and the seed alone: squares modulo a prime, so that SQL can draw the same."""
    key = key.astype(np.int64)
    own = ((key % PRIME) ** 2 + key // PRIME % PRIME * 7907 + 12_345) % PRIME  # squared first, so that no shift of keys equals a shift of samples
    x = (own[None, :] * 31 + samples.astype(np.int64)[:, None] * 7919 + seed * 104_729) % PRIME
    for c in (12_345, 67_891, 24_680):
        x = (x * x + c) % PRIME
    return x / PRIME


def _drawn(df: DataFrame, by: list[str], key: str, x: str, samples: np.ndarray, weight) -> DataFrame:
    """by, b, w, wx: for each sample the sums of weights and weighted values, one row a group, sample and batch."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "") + "b int, w double, wx double"

    def run(it):
        for pdf in it:
            for keys, part in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                w, wx = np.zeros(samples.size), np.zeros(samples.size)
                for i in range(0, len(part), 4096):
                    some = part.iloc[i : i + 4096]
                    drawn = weight(some["_key"].to_numpy(np.int64))
                    w += drawn.sum(axis=1)
                    wx += drawn @ some["_x"].to_numpy(float)
                out = pd.DataFrame({"b": samples.astype(np.int32), "w": w, "wx": wx})
                for c, k in zip(by, keys, strict=True):
                    out[c] = k
                yield out[[*by, "b", "w", "wx"]]

    d = df.select(*by, F.col(key).cast("long").alias("_key"), F.col(x).cast("double").alias("_x")).where("_x is not null and _key is not null")
    return d.mapInPandas(run, schema).groupBy(*by, "b").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))


def bootstrap_mean(df: DataFrame, by: list[str], key: str, x: str, samples: int = 200, level: float = 0.95, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean by the Poisson bootstrap: a row's counts are drawn from its key, so the partitioning changes nothing, and only sums are shuffled."""
    every = np.arange(1, samples + 1)
    s = _drawn(df, by, key, x, every, lambda k: np.searchsorted(_POISSON, draws(k, every, seed), "right").astype(float))
    m = s.groupBy(*by, "b").agg(F.try_divide(F.sum("wx"), F.sum("w")).alias("m"))
    a = (1 - level) / 2
    return m.groupBy(*by).agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"), F.stddev_samp("m").alias("se"))


def sign_permutation(df: DataFrame, by: list[str], key: str, x: str, samples: int = 500, seed: int = 1) -> DataFrame:
    """Two-tailed p of the mean against 0 under random signs: sample 0 is the data, the signs of the others are drawn from the rows' keys in one pass, and only sums are shuffled."""
    every = np.arange(samples + 1)

    def signs(k):
        s = np.where(draws(k, every, seed) < 0.5, -1.0, 1.0)
        s[0] = 1.0
        return s

    m = _drawn(df, by, key, x, every, signs).select(*by, "b", F.col("wx").alias("m"))
    own = m.where("b = 0").select(*by, F.abs("m").alias("observed"))
    j = m.join(own, by) if by else m.crossJoin(F.broadcast(own))
    reached = F.abs("m") >= F.col("observed") * (1 - 1e-12)
    return j.groupBy(*by).agg((F.count_if(reached) / F.count("*")).alias("p"))


def whitened_regression(df: DataFrame, by: list[str], t: list[str], y: str, x: str) -> DataFrame:
    """AR(1) least squares: the residuals' lag-1 correlation, rounded to 0.05, whitens both sides, and the line is fitted anew."""
    w = Window.partitionBy(*by)
    o = Window.partitionBy(*by).orderBy(*t)
    d = df.select(*by, *t, F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null")
    d = d.withColumn("_r", F.col("_y") - F.regr_intercept("_y", "_x").over(w) - F.regr_slope("_y", "_x").over(w) * F.col("_x"))
    d = d.withColumn("_r1", F.lag("_r").over(o)).withColumn("_x1", F.lag("_x").over(o)).withColumn("_y1", F.lag("_y").over(o))
    rho = d.groupBy(*by).agg((F.round(20 * F.coalesce(good(F.corr("_r", "_r1")), F.lit(0.0))) / 20).alias("rho"))
    j = d.join(rho, by).where("_x1 is not null")
    white = j.select(*by, "rho", (F.col("_y") - F.col("rho") * F.col("_y1")).alias("_wy"), (F.col("_x") - F.col("rho") * F.col("_x1")).alias("_wx"))
    return white.groupBy(*by, "rho").agg(F.regr_slope("_wy", "_wx").alias("slope"), F.count("*").alias("n"))
