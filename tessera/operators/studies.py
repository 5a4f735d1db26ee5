"""Study-level operators: mediation, repeated measures, quality, meta-analysis of points, physiology, protocols."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PRIME, good
from ..store import written
from .joins import radius_join
from .windows import beside


def mediation(df: DataFrame, by: list[str], x: str, m: str, y: str) -> DataFrame:
    """Paths a (x to m), b (m to y given x), c (x to y), c' (x to y given m), ab, and Sobel's z of ab; from second moments only."""
    s = df.groupBy(*by).agg(
        F.var_samp(x).alias("vx"), F.var_samp(m).alias("vm"), F.var_samp(y).alias("vy"), F.covar_samp(x, m).alias("xm"), F.covar_samp(x, y).alias("xy"), F.covar_samp(m, y).alias("my"), F.count("*").alias("n"),
    )
    c = F.col
    det = c("vx") * c("vm") - c("xm") * c("xm")
    s = s.withColumn("a", F.try_divide(c("xm"), c("vx"))).withColumn("c", F.try_divide(c("xy"), c("vx")))
    s = s.withColumn("b", F.try_divide(c("my") * c("vx") - c("xy") * c("xm"), det)).withColumn("c_direct", F.try_divide(c("xy") * c("vm") - c("my") * c("xm"), det))
    va = F.try_divide((c("vm") - c("a") * c("xm")) * (c("n") - 1) / (c("n") - 2), (c("n") - 1) * c("vx"))
    rest = (c("vy") - c("c_direct") * c("xy") - c("b") * c("my")) * (c("n") - 1) / (c("n") - 3)
    vb = F.try_divide(rest * c("vx"), (c("n") - 1) * det)
    ab = c("a") * c("b")
    z = F.try_divide(ab, F.sqrt(c("b") * c("b") * va + c("a") * c("a") * vb))
    return s.select(*by, "a", "b", "c", "c_direct", ab.alias("ab"), F.coalesce(good(z), F.lit(0.0)).alias("z"), "n")


def repeated_measures(df: DataFrame, subject: str, level: str, x: str) -> DataFrame:
    """F of a within-subject factor; only subjects with a value at every level take part."""
    cells = df.groupBy(subject, level).agg(F.avg(x).alias("v"))
    k = cells.select(level).distinct().agg(F.count("*").alias("k"))
    full = cells.groupBy(subject).agg(F.count("*").alias("own"), F.sum("v").alias("s")).crossJoin(F.broadcast(k)).where("own = k")
    d = cells.join(full.select(subject, "k"), subject)
    total = d.agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.max("k").alias("k"), F.countDistinct(subject).alias("n"))
    by_level = d.groupBy(level).agg(F.sum("v").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    by_subject = full.agg(F.sum(F.col("s") * F.col("s")).alias("uu"))
    r = total.crossJoin(F.broadcast(by_level)).crossJoin(F.broadcast(by_subject))
    c = F.col
    base = c("s") * c("s") / (c("n") * c("k"))
    effect, subjects = c("tt") / c("n") - base, c("uu") / c("k") - base
    error = c("ss") - base - effect - subjects
    df1, df2 = c("k") - 1, (c("k") - 1) * (c("n") - 1)
    return r.select(F.try_divide(effect / df1, error / df2).alias("f"), df1.alias("df1"), df2.alias("df2"), c("n").alias("n_subjects"))


def paired_t(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    d = good(F.col(x) - F.col(y))
    return df.groupBy(*by).agg(F.coalesce(good(F.sqrt(F.count(d)) * F.try_divide(F.avg(d), F.stddev_samp(d))), F.lit(0.0)).alias("t"), (F.count(d) - 1).alias("df"))


def jackknife(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """The jackknife's standard error of the mean: from sums, since a leave-one-out mean is a difference of sums."""
    s = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("v"))
    return s.select(*by, "mean", F.sqrt(F.col("v") / F.col("n")).alias("se"), "n")


def temporal_quality(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean, sd and signal-to-noise of every series."""
    m, s = F.avg(good(x)), F.stddev_samp(good(x))
    return df.groupBy(*by).agg(m.alias("mean"), s.alias("sd"), F.coalesce(good(F.try_divide(m, s)), F.lit(0.0)).alias("snr"))


def orthogonalise(df: DataFrame, by: list[str], keep: str, change: str, out: str = "orthogonal") -> DataFrame:
    """``change`` less its projection on ``keep``."""
    d = beside(df, by, _kc=F.sum(F.col(keep) * F.col(change)), _kk=F.sum(F.col(keep) * F.col(keep)))
    k = F.coalesce(F.try_divide(F.col("_kc"), F.col("_kk")), F.lit(0.0))
    return d.withColumn(out, F.col(change) - k * F.col(keep)).drop("_kc", "_kk")


def rest_intervals(events: DataFrame, by: list[str], onset: str, offset: str, least: float) -> DataFrame:
    """The gaps of at least that length between the covered stretches of a protocol."""
    w = Window.partitionBy(*by).orderBy(onset, offset)
    end = F.max(offset).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = events.select(*by, end.alias(onset), F.lead(onset).over(w).alias(offset))
    return d.where(F.col(offset) - F.col(onset) >= least)


def to_volumes(events: DataFrame, onset: str, offset: str, tr: float) -> DataFrame:
    """Times as 1-based volume numbers; an event covers one volume at least."""
    first = F.floor(F.col(onset) / tr) + 1
    return events.withColumn(onset, first).withColumn(offset, F.greatest(first, F.ceil(F.col(offset) / tr)))


def concatenate_runs(df: DataFrame, run: str, t: str, out: str = "t_all") -> DataFrame:
    """A time column over all runs, each run after the one before; run lengths are a small aggregate."""
    n = df.groupBy(run).agg(F.max(t).alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return df.join(n, run).withColumn(out, F.col(t) + F.col("_before")).drop("_before")


def region_courses(samples: DataFrame, members: DataFrame, voxel: list[str], region: str, t: str, x: str) -> DataFrame:
    """The mean course of every region."""
    j = samples.join(members.select(region, *voxel).distinct(), voxel)
    return j.groupBy(region, t).agg(F.avg(x).alias(x), F.count("*").alias("n"))


def point_density(points: DataFrame, study: str, weight: str, axes: list[str], cells: DataFrame, radius: float) -> DataFrame:
    """axes and the weighted share of studies with a point within the radius of each cell: a study counts once a cell."""
    total = points.groupBy(study).agg(F.max(weight).alias("_w")).agg(F.sum("_w").alias("_all"))
    near = radius_join(points.select(study, weight, *axes), cells.select(*axes), axes, radius)
    once = near.groupBy(study, *[f"other_{a}" for a in axes]).agg(F.max(weight).alias("_w"))
    s = once.groupBy(*[f"other_{a}" for a in axes]).agg(F.sum("_w").alias("_s"), F.count("*").alias("n_studies")).crossJoin(F.broadcast(total))
    return s.select(*[F.col(f"other_{a}").alias(a) for a in axes], F.try_divide(F.col("_s"), F.col("_all")).alias("density"), "n_studies")


def density_null(points: DataFrame, key: str, study: str, weight: str, axes: list[str], cells: DataFrame, radius: float, draws: int, seed: int = 1) -> DataFrame:
    """b (1 to ``draws``) and highest: the greatest weighted share of studies over the cells when every point is dealt to a random cell, for the null of ``point_density``.

    A point's cells depend on its integer ``key``, the draw and the seed alone.
    Cells are numbered by ranges of their order, and a study counts once a number
    before it meets its cell, so no shuffle is larger than draws x studies x cells.
    Points without a key are left out; a draw without points gives 0.
    """
    order = [F.col(a).asc() for a in axes]
    grid = written(cells.select(*axes).distinct().repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "grid")
    parts = grid.groupBy("_p").agg(F.count("*").alias("_n"))
    parts = parts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = grid.join(parts, "_p").select(*axes, (F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).alias("_i"))
    n = grid.count()
    k = F.col(key).cast("long") % PRIME
    p = points.where(F.col(key).isNotNull()).select((k * k).alias("_u"), study, weight, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b"))
    p = p.withColumn("_u", ((F.col("_u") + 12_345) % PRIME * 31 + F.col("b") * 7919 + seed * 104_729) % PRIME)
    for c in (12_345, 67_891, 24_680):  # a column each time: one expression would hold all its powers of two
        p = p.withColumn("_u", (F.col("_u") * F.col("_u") + c) % PRIME)
    p = p.select("b", study, weight, F.expr(f"_u * {n} div {PRIME}").alias("_i")).groupBy("b", study, "_i").agg(F.max(weight).alias(weight))
    reach = int(radius)
    near = [o for o in product(range(-reach, reach + 1), repeat=len(axes)) if sum(v * v for v in o) <= radius * radius]
    shift = F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in near])
    at = p.join(numbered, "_i").groupBy("b", study, *axes).agg(F.max(weight).alias("_w")).withColumn("_o", F.explode(shift))
    at = at.select("b", study, "_w", *[(F.col(a) + F.col(f"_o.d{i}")).alias(a) for i, a in enumerate(axes)]).join(grid.select(*axes), axes, "left_semi")
    once = at.groupBy("b", study, *axes).agg(F.max("_w").alias("_w"))
    total = points.groupBy(study).agg(F.max(weight).alias("_w")).agg(F.sum("_w").alias("_all"))
    top = once.groupBy("b", *axes).agg(F.sum("_w").alias("_s")).groupBy("b").agg(F.max("_s").alias("_s")).crossJoin(F.broadcast(total))
    every = points.sparkSession.range(1, draws + 1).select(F.col("id").cast("int").alias("b"))
    return every.join(top, "b", "left").select("b", F.coalesce(F.try_divide("_s", "_all"), F.lit(0.0)).alias("highest"))


def peaks(df: DataFrame, by: list[str], t: list[str], x: str, threshold: float) -> DataFrame:
    """Rows above the threshold that exceed the row before and are not below the row after."""
    w = Window.partitionBy(*by).orderBy(*t)
    d = df.withColumn("_p", F.lag(x).over(w)).withColumn("_q", F.lead(x).over(w))
    return d.where((F.col(x) >= threshold) & (F.col(x) > F.col("_p")) & (F.col(x) >= F.col("_q"))).drop("_p", "_q")


def interval_variability(beats: DataFrame, by: list[str], t: str) -> DataFrame:
    """Mean interval, its sd, the root mean square of successive differences and the share of those over 50 ms; t in seconds."""
    w = Window.partitionBy(*by).orderBy(t)
    d = beats.select(*by, t, (F.col(t) - F.lag(t).over(w)).alias("i"))
    d = d.withColumn("s", F.col("i") - F.lag("i").over(w))
    return d.groupBy(*by).agg(F.avg("i").alias("mean"), F.stddev_samp("i").alias("sdnn"), F.sqrt(F.avg(F.col("s") * F.col("s"))).alias("rmssd"), F.try_divide(F.count_if(F.abs("s") > 0.05), F.count("s")).alias("pnn50"), F.count("i").alias("n"))


def share_below(df: DataFrame, by: list[str], x: str, out: str = "share") -> DataFrame:
    """The share of a group's values at or below each: distinct values are counted before they are ordered."""
    c = df.groupBy(*by, x).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn(out, F.sum("_c").over(up) / F.sum("_c").over(Window.partitionBy(*by))).drop("_c")
    return df.join(c, [*by, x])


def range_grid(spark, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """d1, d2 ...: all points of a grid of (from, step, to) ranges."""
    d = spark.range(1)
    for i, (a, s, b) in enumerate(ranges, 1):
        d = d.withColumn(f"d{i}", F.explode(F.sequence(F.lit(a), F.lit(b), F.lit(s))))
    return d.drop("id")


def winner(df: DataFrame, by: list[str], label: str, x: str | Column) -> DataFrame:
    """The label of the largest value of each group, the first of ties."""
    v = F.col(x) if isinstance(x, str) else x
    return df.groupBy(*by).agg(F.min_by(label, F.struct(-v, F.col(label))).alias("winner"))
