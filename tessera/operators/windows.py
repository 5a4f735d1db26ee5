"""Transforms along a series: every function partitions by the series and orders by its time column.

What needs an order is a window whose partition is one series, so the longest
series bounds a task.  What needs none is an aggregate joined back (``beside``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import drawn, good
from ..store import written


def beside(df: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """``df`` with aggregates of each row's group as columns.

    The aggregates are summed before the shuffle and joined back, so a group
    that holds a third of all rows is split by the join's skew handling (or the
    small side is broadcast by its size) and never meets in one task, as it
    would in a window.  Null keys are a group.
    """
    return joined_groups(df, df.groupBy(*by).agg(*[v.alias(k) for k, v in stats.items()]), by)


def joined_groups(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of its group's row in ``groups``; null keys are a group."""
    if not by:
        return df.crossJoin(F.broadcast(groups))
    g = groups.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on &= df[c].eqNullSafe(g[f"_by_{c}"])
    return df.join(g, on).drop(*[f"_by_{c}" for c in by])


def z_transform(df: DataFrame, by: list[str], x: str, out: str = "z") -> DataFrame:
    d = beside(df, by, _m=F.avg(x), _s=F.stddev_samp(x))
    return d.withColumn(out, F.try_divide(F.col(x) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def percent_change(df: DataFrame, by: list[str], x: str, base: Column | None = None, out: str = "psc") -> DataFrame:
    """100 x / mean, the mean over the rows of ``base`` (all by default); 0 where that is impossible."""
    d = beside(df, by, _m=F.avg(F.when(base, F.col(x)) if base is not None else F.col(x)))
    return d.withColumn(out, F.coalesce(good(F.try_divide(100 * F.col(x), F.col("_m"))), F.lit(0.0))).drop("_m")


def value_ranks(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, each different value of ``x`` (bad ones are null), its number ``c`` of rows, how many rows of the group have less (``before``; nulls come last), and the group's rows ``n``.

    Values are counted first.  Their order is one of ranges: each partition has
    a range of values and ranks its own, and the sums of the partitions before
    it are added, so a group of any size is ordered by many tasks.
    """
    v = df.select(*by, good(x).alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("c"))
    order = [*[F.col(c).asc_nulls_first() for c in by], F.col("_v").asc_nulls_last()]
    v = written(v.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "values")
    parts = v.groupBy(*by, "_p").agg(F.sum("c").alias("_s"))
    upto = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_p", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy(*by)).alias("n"))
    own = Window.partitionBy(*by, "_p").orderBy(F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("_own", F.coalesce(F.sum("c").over(own), F.lit(0)))
    return joined_groups(v, parts, [*by, "_p"]).select(*by, "_v", "c", (F.col("_b") + F.col("_own")).alias("before"), "n")


def rank_transform(df: DataFrame, by: list[str], x: str, centred: bool = False, out: str = "rank") -> DataFrame:
    """Mean ranks from 1; bad values rank last."""
    r = F.col("before") + (F.col("c") + 1) / 2
    if centred:
        r = r - (F.col("n") + 1) / 2
    ranks = value_ranks(df, by, x).select(*by, "_v", r.alias("_rank"))
    return joined_groups(df.withColumn("_v", good(x)), ranks, [*by, "_v"]).withColumn(out, F.col("_rank")).drop("_v", "_rank")


def linear_scale(df: DataFrame, by: list[str], x: str, high: float = 1.0, low: float = 0.0, out: str = "scaled") -> DataFrame:
    d = beside(df, by, _lo=F.min(x), _hi=F.max(x))
    return d.withColumn(out, low + (F.col(x) - F.col("_lo")) * F.try_divide(F.lit(high - low), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def moving_sum(df: DataFrame, by: list[str], t: str, x: str, weights: list[float], out: str = "moving") -> DataFrame:
    """A trailing weighted sum: weights[i] times the value i steps back; values before the start count as 0."""
    w = Window.partitionBy(*by).orderBy(t)
    total = None
    for i, k in enumerate(weights):
        term = k * F.coalesce(F.lag(x, i).over(w) if i else F.col(x), F.lit(0.0))
        total = term if total is None else total + term
    return df.withColumn(out, total)


def moving_average(df: DataFrame, by: list[str], t: str, x: str, before: int, after: int, out: str = "moving_avg") -> DataFrame:
    return df.withColumn(out, F.avg(x).over(Window.partitionBy(*by).orderBy(t).rowsBetween(-before, after)))


def lagged_correlation(df: DataFrame, by: list[str], t: list[str], x: str, lag: int = 1) -> DataFrame:
    """Autocorrelation at a lag in rows: the correlation of each series with itself shifted."""
    w = Window.partitionBy(*by).orderBy(*t)
    return df.select(*by, F.col(x).alias("_a"), F.lag(x, lag).over(w).alias("_b")).where("_b is not null").groupBy(*by).agg(F.corr("_a", "_b").alias("r"), F.count("*").alias("n"))


def covariance(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.covar_samp(x, y).alias("cov"), F.corr(x, y).alias("r"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))


def winsorize(df: DataFrame, by: list[str], x: str, sd: float = 3.0, passes: int = 3, out: str = "winsorized") -> DataFrame:
    """Values beyond ``sd`` deviations become the mean, in passes; the deviation is scaled to the values that are none.

    Groups of fewer than four values stay as they are; a group whose number of
    outliers no longer changes has settled, and later passes leave it alone.  A
    pass is one aggregation of the rows beside the group's last mean and deviation.
    """
    raw = good(x)
    g = df.groupBy(*by).agg(F.count(raw).alias("_n"), F.avg(raw).alias("_m"), F.stddev_samp(raw).alias("_s"))
    g = g.withColumn("_open", F.col("_n") >= 4).withColumn("_last", F.lit(-1).cast("long"))
    far = (F.col("_n") >= 4) & (F.abs(raw - F.col("_m")) > sd * F.col("_s"))
    value = F.when(far, F.col("_m")).otherwise(raw)
    for _ in range(passes - 1):
        keep = [F.first(c).alias(c) for c in ("_n", "_m", "_s", "_open", "_last")]
        n = joined_groups(df, g, by).groupBy(*by).agg(*keep, F.count_if(far).alias("_c"), F.avg(value).alias("_m2"), F.stddev_samp(value).alias("_s2"))
        # replaced values add nothing to the spread, so it is scaled to the rest
        scaled = F.col("_s2") * F.sqrt(F.when(F.col("_c") > 0, (F.col("_n") - 1) / F.greatest(F.col("_n") - F.col("_c") - 1, F.lit(1))).otherwise(F.lit(1.0)))
        still = F.col("_open") & (F.col("_c") != F.col("_last"))
        g = n.select(*by, "_n", F.when(still, F.col("_m2")).otherwise(F.col("_m")).alias("_m"), F.when(still, scaled).otherwise(F.col("_s")).alias("_s"), still.alias("_open"), F.col("_c").alias("_last"))
    return joined_groups(df, g, by).withColumn(out, F.coalesce(value, F.col(x))).drop("_n", "_m", "_s", "_open", "_last")


def detrend(df: DataFrame, by: list[str], t: str, x: str, out: str = "detrended") -> DataFrame:
    """``x`` less its least-squares line over t (the mean stays)."""
    d = beside(df, by, _k=F.regr_slope(x, t), _t=F.avg(t))
    return d.withColumn(out, F.col(x) - F.coalesce("_k", F.lit(0.0)) * (F.col(t) - F.col("_t"))).drop("_k", "_t")


def transitions(df: DataFrame, by: list[str], t: list[str], state: str) -> DataFrame:
    """before, after, n and the share of each transition among those from ``before``, over all sequences."""
    w = Window.partitionBy(*by).orderBy(*t)
    n = df.select(F.lag(state).over(w).alias("before"), F.col(state).alias("after")).where("before is not null").groupBy("before", "after").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def gradient_magnitude(df: DataFrame, axes: list[str], x: str, out: str = "gradient") -> DataFrame:
    """The length of the central-difference gradient on a grid; a missing neighbour gives a zero component."""
    d, parts = df, []
    for i, a in enumerate(axes):
        rest = [b for b in axes if b != a]
        w = Window.partitionBy(*rest).orderBy(a)
        ahead = F.when(F.lead(a).over(w) == F.col(a) + 1, F.lead(x).over(w))
        back = F.when(F.lag(a).over(w) == F.col(a) - 1, F.lag(x).over(w))
        d = d.withColumn(f"_g{i}", F.coalesce((ahead - back) / 2, F.lit(0.0)))
        parts.append(F.col(f"_g{i}") * F.col(f"_g{i}"))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return d.withColumn(out, F.sqrt(total)).drop(*[f"_g{i}" for i in range(len(axes))])


def sliding_blocks(df: DataFrame, by: list[str], t: str, x: str, width: int) -> DataFrame:
    """One row a full window of ``width`` consecutive rows: its first time and its values."""
    w = Window.partitionBy(*by).orderBy(t).rowsBetween(0, width - 1)
    return df.withColumn("block", F.collect_list(x).over(w)).where(F.size("block") == width).select(*by, t, "block")


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve: distinct scores are pre-counted, so ties share a step and a window holds distinct scores only."""
    g = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2)
    out = g.withColumn("wins", wins).groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return out.select(*by, F.try_divide(F.col("wins"), F.col("p") * F.col("q")).alias("auc"), F.col("p").alias("n_pos"), F.col("q").alias("n_neg"))


def _inversions(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """Pairs of points (counted ``c`` times) of which one has less x and more y."""
    order = np.lexsort((y, x))
    y, c = y[order], c[order]

    def count(lo: int, hi: int) -> tuple[int, np.ndarray, np.ndarray]:
        if hi - lo <= 64:
            above = np.triu(y[lo:hi, None] > y[None, lo:hi], 1)
            mine = np.argsort(y[lo:hi], kind="stable")
            return int(c[lo:hi] @ above @ c[lo:hi]), y[lo:hi][mine], c[lo:hi][mine]
        mid = (lo + hi) // 2
        (a, ly, lc), (b, ry, rc) = count(lo, mid), count(mid, hi)
        sums = np.concatenate([[0], np.cumsum(lc)])
        across = int(((sums[-1] - sums[np.searchsorted(ly, ry, "right")]) * rc).sum())
        both, bc = np.concatenate([ly, ry]), np.concatenate([lc, rc])
        mine = np.argsort(both, kind="stable")
        return a + b + across, both[mine], bc[mine]

    return count(0, y.size)[0] if y.size else 0


def kendall_counts(df: DataFrame, by: list[str], x: str, y: str, bucket: int = 1024) -> DataFrame:
    """by, n, pairs untied in both columns, and the discordant ones among them, in n log n steps; rows with a bad value are left out.

    Points fall into buckets of about the square root of a group's rows (``bucket`` at
    least) by rank in x and in y; a value with more rows is a bucket of its own.
    Discordant pairs in one bucket of x, and those in one bucket of y but
    different ones of x, are counted inside these buckets; the others are
    products of bucket counts with two-dimensional prefix sums.  So a group is
    split over many tasks, none of which sees more than a bucket's points.  In
    groups of up to a quarter of ``bucket`` rows, points are compared in pairs.
    """
    d = df.select(*by, good(x).alias("_x"), good(y).alias("_y")).where("_x is not null and _y is not null")
    points = written(d.groupBy(*by, "_x", "_y").agg(F.count("*").alias("_c")), "points")
    sizes = written(points.groupBy(*by).agg(F.sum("_c").alias("n")), "sizes")
    few = joined_groups(points, sizes.where(F.col("n") <= bucket // 4).select(*by), by)
    a, b = few.alias("a"), few.alias("b")
    on = (F.col("a._x") < F.col("b._x")) & (F.col("a._y") > F.col("b._y"))
    for c in by:
        on &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    found = a.join(b, on).groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.sum(F.col("a._c") * F.col("b._c")).alias("discordant"))
    large = sizes.where(F.col("n") > bucket // 4)
    if not large.isEmpty():
        found = found.unionByName(_by_buckets(joined_groups(points, large.select(*by), by), joined_groups(d, large.select(*by), by), by, bucket))
    pairs = lambda c: F.expr(f"sum({c} * ({c} - 1) div 2)")
    both = points.groupBy(*by).agg(F.sum("_c").alias("n"), pairs("_c").alias("_xy"))
    for a in "xy":
        ties = points.groupBy(*by, f"_{a}").agg(F.sum("_c").alias("_t")).groupBy(*by).agg(pairs("_t").alias(f"_ties_{a}"))
        both = joined_groups(both, ties, by)
    untied = F.expr("n * (n - 1) div 2") - F.col("_ties_x") - F.col("_ties_y") + F.col("_xy")
    return joined_left(both, found, by).select(*by, "n", untied.alias("pairs"), F.coalesce("discordant", F.lit(0)).alias("discordant"))


def _by_buckets(points: DataFrame, d: DataFrame, by: list[str], bucket: int) -> DataFrame:
    """by and discordant pairs of large groups."""
    for a in "xy":
        wide = F.greatest(F.lit(bucket), F.ceil(F.sqrt("n")))
        # a value of more rows than a bucket is the last that begins in its stretch, and comes behind the others there
        v = value_ranks(d, by, f"_{a}").select(*by, F.col("_v").alias(f"_{a}"), F.col("n").alias(f"_n{a}"), F.col("c").alias(f"_t{a}"), (2 * F.floor(F.col("before") / wide) + (F.col("c") > wide).cast("int")).alias(f"_b{a}"), (F.col("c") > wide).alias(f"_one{a}"))
        points = joined_groups(points, v, [*by, f"_{a}"])
    points = written(points, "points")
    schema = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "") + "d long"

    def within(first: str):
        def run(key, pdf):
            return pd.DataFrame([[*key[: len(by)], _inversions(pdf[first].to_numpy(), pdf["_y"].to_numpy(), pdf["_c"].to_numpy(np.int64))]], columns=[*by, "d"])

        return run

    same_x = points.where("not _onex").groupBy(*by, "_bx").applyInPandas(within("_x"), schema)
    same_y = points.where("not _oney").groupBy(*by, "_by").applyInPandas(within("_bx"), schema)
    cells = points.groupBy(*by, "_bx", "_by").agg(F.sum("_c").alias("_c"))
    # for each cell, the points in buckets of less x and more y: rows of less x by their sums over more y, over the grid of buckets that occur
    rows, columns = cells.select(*by, "_bx").distinct(), cells.select(*by, "_by").distinct()
    grid = joined_groups(rows, columns.groupBy(*by).agg(F.collect_set("_by").alias("_all")), by).select(*by, "_bx", F.explode("_all").alias("_by"))
    full = joined_left(grid, cells, [*by, "_bx", "_by"]).withColumn("_c", F.coalesce("_c", F.lit(0)))
    more_y = Window.partitionBy(*by, "_bx").orderBy(F.desc("_by")).rowsBetween(Window.unboundedPreceding, -1)
    less_x = Window.partitionBy(*by, "_by").orderBy("_bx").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("_m", F.coalesce(F.sum("_c").over(more_y), F.lit(0))).withColumn("_q", F.coalesce(F.sum("_m").over(less_x), F.lit(0)))
    apart = full.where("_c > 0").select(*by, (F.col("_c") * F.col("_q")).alias("d"))
    return same_x.unionByName(same_y).unionByName(apart).groupBy(*by).agg(F.sum("d").alias("discordant"))


def joined_left(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of the row of ``other`` that has its keys (null-safe), or nulls."""
    g = other.withColumnsRenamed({c: f"_by_{c}" for c in keys})
    on = F.lit(True)
    for c in keys:
        on &= df[c].eqNullSafe(g[f"_by_{c}"])
    return df.join(g, on, "left").drop(*[f"_by_{c}" for c in keys])


def kendall_tau(df: DataFrame, by: list[str], pos: str, x: str, y: str, bucket: int = 1024) -> DataFrame:
    """by, Kendall's tau over the pairs untied in both columns (0 if there is none), n and its approximate z under independence; the order of the rows (``pos``) doesn't matter."""
    k = kendall_counts(df, by, x, y, bucket)
    tau = F.coalesce(F.try_divide(F.col("pairs") - 2 * F.col("discordant"), F.col("pairs")), F.lit(0.0))
    n = F.col("n")
    z = F.coalesce(good(F.try_divide(F.col("tau"), F.sqrt(F.try_divide(2 * (2 * n + 5), 9 * n * (n - 1))))), F.lit(0.0))
    return k.select(*by, tau.alias("tau"), "n").withColumn("z", z)


def first_nonzero(df: DataFrame, by: list[str], pos: str, x: str) -> DataFrame:
    """The first and last position of a value other than 0; null if there is none."""
    p = F.when(F.col(x) != 0, F.col(pos))
    return df.groupBy(*by).agg(F.min(p).alias("first"), F.max(p).alias("last"))


def extreme_positions(df: DataFrame, by: list[str], pos: str, x: str) -> DataFrame:
    """The positions of the largest and the smallest value, the first of ties."""
    return df.groupBy(*by).agg(F.min_by(pos, F.struct(-F.col(x), F.col(pos))).alias("max_pos"), F.min_by(pos, F.struct(F.col(x), F.col(pos))).alias("min_pos"))


def shuffled(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """A permutation that a rerun repeats: rows numbered by a number drawn from an integer key and the seed."""
    w = Window.partitionBy(*by).orderBy(drawn(key, seed), key)
    return df.withColumn("place", F.row_number().over(w))
