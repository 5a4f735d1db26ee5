"""Grouped aggregates over good (finite) values.

Every function takes a DataFrame, its grouping columns and value columns, and
plans partial aggregation before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import Col, col, good, steady_sum


def conditional_sum(df: DataFrame, n: int, key: Col, value: Col) -> DataFrame:
    """key 1..n and the sum of its values: bad keys or values are skipped, keys are cut to integers, absent keys give 0."""
    k = F.floor(good(col(key).cast("double"))).cast("int")
    got = df.select(k.alias("key"), good(col(value).cast("double")).alias("v")).where(F.col("key").between(1, n) & F.col("v").isNotNull()).groupBy("key").agg(F.sum("v").alias("total"))
    keys = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("key"))
    return keys.join(got, "key", "left").select("key", F.coalesce("total", F.lit(0.0)).alias("total"))


def _bin(v: Column, low: float, high: float, step: float) -> Column:
    return F.floor((F.least(v, F.lit(float(high))) - low) / step).cast("int") + 1


def histogram(df: DataFrame, dims: list[tuple[Col, float, float, float]], weight: Col | None = None) -> DataFrame:
    """bin1[, bin2 ...] and n (or the weight's sum): values below a range are dropped, those above go to its last bin."""
    d = df
    for i, (v, low, high, step) in enumerate(dims, 1):
        x = good(col(v).cast("double"))
        d = d.where(x >= low).withColumn(f"bin{i}", _bin(x, low, high, step))
    bins = [f"bin{i}" for i in range(1, len(dims) + 1)]
    return d.groupBy(*bins).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def histogram_nd(df: DataFrame, dims: list[tuple[Col, float, float, float]]) -> DataFrame:
    """bin1.. and n with all values outside a range dropped; bins number from 1 by floor(1 + steps * share)."""
    d = df
    for i, (v, low, high, step) in enumerate(dims, 1):
        x = good(col(v).cast("double"))
        steps = int(np.ceil((0.25 * step + high - low) / step)) - 1
        d = d.where(x.between(low, high)).withColumn(f"bin{i}", F.floor(1 + steps / (high - low) * (x - low)).cast("int"))
    return d.groupBy(*[f"bin{i}" for i in range(1, len(dims) + 1)]).agg(F.count("*").alias("n"))


def good_mean(x: Col) -> Column:
    """The mean of good values, 0 if there is none."""
    return F.coalesce(F.avg(good(x)), F.lit(0.0))


def good_sd(x: Col) -> Column:
    return F.stddev_samp(good(x))


def safe_variance(x: Col) -> Column:
    """n-1 variance of good values, 0 for one value or none."""
    return F.coalesce(F.var_samp(good(x)), F.lit(0.0))


def harmonic_mean(x: Col) -> Column:
    g = good(x)
    return F.try_divide(F.count(g), steady_sum(F.try_divide(F.lit(1.0), g)))  # reciprocals of both signs nearly cancel


def root_mean_square(x: Col) -> Column:
    return F.sqrt(F.avg(good(x) * good(x)))


def skew(x: Col, corrected: bool = False) -> Column:
    """Null for fewer than three good values if corrected."""
    g = good(x)
    n = F.count(g)
    return F.skewness(g) * F.sqrt(F.try_divide(n - 1, n)) * F.try_divide(n, n - 2) if corrected else F.skewness(g)


def kurtosis(x: Col, corrected: bool = False) -> Column:
    """Not in excess of 3; null for fewer than four good values if corrected."""
    g = good(x)
    k = F.kurtosis(g) + 3
    n = F.count(g)
    return F.try_divide(((n + 1) * k - 3 * (n - 1)) * (n - 1), (n - 2) * (n - 3)) + 3 if corrected else k


def shape(df: DataFrame, by: list[str], x: Col) -> DataFrame:
    """by, skew, kurtosis and both corrected.  Good values are a column of their own before the aggregates: inside of them their test makes code too long to be compiled."""
    s = df.select(*by, good(x).alias("_x")).groupBy(*by).agg(F.skewness("_x").alias("skew"), (F.kurtosis("_x") + 3).alias("kurtosis"), F.count("_x").alias("_n"))
    n, k = F.col("_n"), F.col("kurtosis")
    skewed = F.col("skew") * F.sqrt(F.try_divide(n - 1, n)) * F.try_divide(n, n - 2)
    peaked = F.try_divide(((n + 1) * k - 3 * (n - 1)) * (n - 1), (n - 2) * (n - 3)) + 3
    return s.select(*by, "skew", "kurtosis", skewed.alias("skew_corrected"), peaked.alias("kurtosis_corrected"))


def min_max_mean(df: DataFrame, by: list[str], x: str, pos: str) -> DataFrame:
    """Extremes, their first positions, mean and variance in one pass."""
    g = good(x)
    first_low = F.min(F.when(g.isNotNull(), F.struct(g.alias("v"), F.col(pos).alias("p"))))
    first_high = F.min(F.when(g.isNotNull(), F.struct((-g).alias("v"), F.col(pos).alias("p"))))
    out = df.groupBy(*by).agg(first_low.alias("lo"), first_high.alias("hi"), F.avg(g).alias("mean"), F.var_samp(g).alias("variance"))
    return out.select(*by, F.col("lo.v").alias("min"), (-F.col("hi.v")).alias("max"), "mean", F.col("lo.p").alias("min_pos"), F.col("hi.p").alias("max_pos"), "variance")


def ties(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """The number of tied pairs."""
    g = df.groupBy(*by, x).agg(F.count("*").alias("g"))
    return g.groupBy(*by).agg(F.sum(F.expr("g * (g - 1) div 2")).cast("long").alias("ties"))


def spatial_entropy(df: DataFrame, by: list[str], x: str, bins: int | None = None) -> DataFrame:
    """sum p log2 p over equal bins between the extremes (at most 0); max(3, n/100) bins unless given."""
    from .windows import joined_groups

    ends = df.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"))
    nb = F.lit(bins).cast("long") if bins else F.greatest(F.lit(3).cast("long"), F.round(F.col("n") / 100).cast("long"))
    j = joined_groups(df.where(F.col(x).isNotNull()), ends, by)
    b = F.least(nb - 1, F.floor(F.coalesce(F.try_divide(F.col(x) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * nb))
    c = j.groupBy(*by, "n", b.alias("b")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    return c.groupBy(*by).agg(F.sum(p * F.log2(p)).alias("entropy"))


def leave_one_out(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Every row with the mean and n-1 variance of its group without it, from the group's mean and variance."""
    from .windows import beside

    d = beside(df, by, _n=F.count(x), _m=F.avg(x), _v=F.var_pop(x))
    n, away = F.col("_n") - 1, F.col(x) - F.col("_m")
    mean = F.col("_m") - F.try_divide(away, n)
    rest = F.col("_v") * F.col("_n") - F.try_divide(away * away * F.col("_n"), n)
    return d.withColumn("loo_mean", F.when(n > 0, mean)).withColumn("loo_variance", F.try_divide(F.greatest(rest, F.lit(0.0)), n - 1)).drop("_n", "_m", "_v")


#: Sums of a tally: scores count from ``about``, a point near their mean, so that an offset of all scores costs no digits.
TALLY = ("n", "w", "w2", "ws", "wss", "w2s", "w2ss")


def _tally_sums(s: Column, w: Column) -> list[Column]:
    return [F.count(s).alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * s).alias("ws"), F.sum(w * s * s).alias("wss"), F.sum(w * w * s).alias("w2s"), F.sum(w * w * s * s).alias("w2ss")]


def tally(df: DataFrame, by: list[str], score: Col, weight: Col, about: float | None = None) -> DataFrame:
    """Mergeable weighted sums about the group's plain mean (or about a given point, which one pass or a stream needs): the state of a weighted mean and variance."""
    from .windows import beside

    ok = good(score).isNotNull() & good(weight).isNotNull()
    d = df.select(*by, F.when(ok, good(score)).alias("_s"), F.when(ok, good(weight)).alias("_w"))
    d = d.withColumn("about", F.lit(float(about))) if about is not None else beside(d, by, about=F.coalesce(F.avg("_s"), F.lit(0.0)))
    return d.groupBy(*by).agg(F.first("about").alias("about"), *_tally_sums(F.col("_s") - F.col("about"), F.col("_w")))


def merge_tallies(df: DataFrame, by: list[str]) -> DataFrame:
    """Tallies of parts as the tally of the whole: each part's sums move to a common point first."""
    from .windows import beside

    d = beside(df, by, _c=F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("about")), F.sum("n")), F.lit(0.0)))
    k = F.col("about") - F.col("_c")
    moved = {"ws": F.col("ws") + k * F.col("w"), "wss": F.col("wss") + 2 * k * F.col("ws") + k * k * F.col("w"), "w2s": F.col("w2s") + k * F.col("w2"), "w2ss": F.col("w2ss") + 2 * k * F.col("w2s") + k * k * F.col("w2")}
    return d.groupBy(*by).agg(F.first("_c").alias("about"), *[F.sum(moved.get(c, F.col(c))).alias(c) for c in TALLY])


def tally_statistics(t: DataFrame) -> DataFrame:
    """Adds the weighted mean, variance, standard error (ratio-variance form) and effective degrees of freedom of a tally."""
    n, w, w2 = F.col("n"), F.col("w"), F.col("w2")
    mean = F.try_divide(F.col("ws"), w)
    variance = F.try_divide(F.col("wss") - F.col("ws") * mean, w - F.try_divide(w2, w))
    # sum over rows of (w s - mean w)^2, from the sums
    spread = F.col("w2ss") - 2 * mean * F.col("w2s") + mean * mean * w2
    se = F.sqrt(F.try_divide(n, (n - 1) * w * w) * F.greatest(spread, F.lit(0.0)))
    return t.withColumn("mean", F.col("about") + mean).withColumn("variance", variance).withColumn("se", se).withColumn("df", F.try_divide(w * w, w2) - 1)


def orthogonality(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and the cosine of every pair of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    own = {a: str(pairs.index((a, a))) for a in columns}
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.col(str(i)), F.sqrt(F.col(own[a]) * F.col(own[b]))).alias("cosine")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*items)))


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """predictor and 1 / (1 - R^2) of each column on the others: the diagonal of the inverse correlation matrix, of a fixed size."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])

    def invert(it):
        for p in it:
            for r in p.to_numpy(float):
                m = np.linalg.pinv(r.reshape(len(columns), len(columns)))
                yield pd.DataFrame({"predictor": columns, "vif": np.diag(m)})

    return row.mapInPandas(invert, "predictor string, vif double")


def otsu_threshold(df: DataFrame, x: str, bins: int = 256) -> DataFrame:
    """The bin edge that splits the values into two classes of the least summed variance, over a fixed number of bins; the value itself if there is only one."""
    d = df.select(F.col(x).alias("_x")).where("_x is not null")
    ends = d.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    v = F.col("_x") - F.col("lo")  # from the least value, so that an offset costs no digits
    b = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(v, F.col("hi") - F.col("lo")), F.lit(0.0)) * bins)).cast("int")
    h = d.crossJoin(F.broadcast(ends)).groupBy(b.alias("b"), "lo", "hi").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    up = Window.partitionBy("lo").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("lo").orderBy("b").rowsBetween(1, Window.unboundedFollowing)

    def within(w):
        n, s, ss = (F.sum(c).over(w) for c in ("n", "s", "ss"))
        return F.coalesce(ss - F.try_divide(s * s, n), F.lit(0.0))

    scored = h.withColumn("cost", within(up) + within(down)).withColumn("edge", F.col("lo") + (F.col("b") + 1) * (F.col("hi") - F.col("lo")) / bins)
    return scored.agg(F.min(F.struct("cost", "edge")).alias("m")).select(F.col("m.edge").alias("threshold"))


def bounding_box(df: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def average_objects(dfs: list[DataFrame], key: list[str], x: str) -> DataFrame:
    """Several maps over one key space as their mean, sd and number."""
    both = dfs[0].select(*key, x)
    for d in dfs[1:]:
        both = both.unionByName(d.select(*key, x))
    return both.groupBy(*key).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))
