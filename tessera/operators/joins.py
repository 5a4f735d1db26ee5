"""Joins: interval, nearest, as-of, lookup and pair joins without a cross join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written


def interval_join(points: DataFrame, t: str, events: DataFrame, onset: str, before: float, after: float, on: list[str] | None = None) -> DataFrame:
    """Points with every event whose window [onset - before, onset + after) holds them.

    Time is cut into buckets as wide as the window; an event goes to the two
    buckets that it can touch, so this is an equi-join on bucket (and ``on``).
    """
    on = on or []
    width = before + after
    lo = F.floor((F.col(onset) - before) / width)
    hi = F.floor((F.col(onset) + after) / width)
    e = events.withColumn("_b", F.explode(F.sequence(lo, hi)))
    p = points.withColumn("_b", F.floor(F.col(t) / width))
    j = p.join(e, [*on, "_b"])
    return j.where((F.col(t) >= F.col(onset) - before) & (F.col(t) < F.col(onset) + after)).drop("_b")


def radius_join(a: DataFrame, b: DataFrame, axes: list[str], radius: float) -> DataFrame:
    """Pairs (a.*, b.* as other_*) no farther apart than ``radius``: an equi-join on grid cells of that size, each point of ``a`` in all neighbouring cells.

    The pairs can be many times the points, so ``a`` is dealt over all cores, however few its files.
    """
    spark = a.sparkSession
    d = a.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for x in axes:
        c = F.floor(F.col(x) / radius)
        d = d.withColumn(f"_c_{x}", F.explode(F.sequence(c - 1, c + 1)))
    o = b.select(*[F.col(c).alias(f"other_{c}") for c in b.columns])
    for x in axes:
        o = o.withColumn(f"_c_{x}", F.floor(F.col(f"other_{x}") / radius))
    cells = [f"_c_{x}" for x in axes]
    total = None
    for x in axes:
        s = (F.col(x) - F.col(f"other_{x}")) * (F.col(x) - F.col(f"other_{x}"))
        total = s if total is None else total + s
    return d.join(o, cells).withColumn("distance", F.sqrt(total)).where(F.col("distance") <= radius).drop(*cells)


def as_of(left: DataFrame, right: DataFrame, on: list[str], t: str, values: list[str], width: float | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before it.

    With ``width`` (seconds of a timestamp, else units of ``t``) time is cut into
    ranges: rows are ordered within key and range only, and the last value before a
    range comes from the ranges' last values, one row a key and range, so a hot key
    is spread over as many tasks as it has ranges.  Without it a key is one range.
    """
    time = F.col(t).cast("timestamp").cast("double") if dict(left.dtypes)[t].startswith("timestamp") else F.col(t)
    part = F.floor(time / width) if width else F.lit(0).cast("long")
    l = left.withColumn("_side", F.lit(1))  # noqa: E741
    r = right.select(*on, t, F.struct(*values).alias("_v")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_part", part)
    w = Window.partitionBy(*on, "_part").orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    if width:
        ends = both.groupBy(*on, "_part").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col(t))).alias("_end"))
        before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*on, "_part", F.last("_end", ignorenulls=True).over(before).alias("_before"))
        out = out.join(ends, [*on, "_part"], "left").withColumn("_v", F.coalesce("_v", "_before"))
    return out.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def nearest(points: DataFrame, key: str, targets: DataFrame, target: str, axes: list[str], radius: float) -> DataFrame:
    """key, the nearest target within the radius and its distance; ties go to the smallest target; none gives no row.

    Of targets in one place the smallest stands for all.  The radius grows from
    one whose cells hold about one target, twice as long each round; a point that
    has found a target is done, so what is compared follows the points and not
    the pairs within the radius.
    """
    q = written(targets.select(target, *axes).groupBy(*axes).agg(F.min(target).alias(target)), "targets")
    cells = q.select(*[F.floor(F.col(x) / radius).alias(x) for x in axes]).distinct().count()
    halves = max(0, math.ceil(math.log2(max(1, q.count() / max(1, cells))) / len(axes)))
    rest, out = points.select(key, *axes), None
    for i in range(halves, -1, -1):
        reach = radius / 2**i
        # the targets are dealt to the neighbouring cells: a point's candidates meet in one task, and the aggregate leaves one row of them
        j = radius_join(q, rest, axes, reach).select(F.col(f"other_{key}").alias(key), "distance", target)
        best = j.groupBy(key).agg(F.min(F.struct("distance", target)).alias("m")).select(key, F.col(f"m.{target}").alias(target), "m.distance")
        if not i:
            return best if out is None else out.union(best)
        best = written(best.where(F.col("distance") <= 0.999 * reach), "nearest")  # at the very edge a nearer one may lie a cell farther
        out = best if out is None else out.union(best)
        rest = written(rest.join(best.select(key), key, "left_anti"), "points")


def last_match(left: DataFrame, right: DataFrame, value: str, pos: str, exact: bool = False) -> DataFrame:
    """Each left row with ``match``: the last position in ``right`` of an equal string (any case unless ``exact``), else 0."""
    k = (lambda c: F.col(c)) if exact else (lambda c: F.lower(F.col(c)))
    r = right.groupBy(k(value).alias("_k")).agg(F.max(pos).alias("_p"))
    return left.withColumn("_k", k(value)).join(r, "_k", "left").withColumn("match", F.coalesce("_p", F.lit(0))).drop("_k", "_p")


def pattern_match(left: DataFrame, patterns: list[str], value: str) -> DataFrame:
    """Each row with ``match``: the number (from 1) of the last pattern found in any case, else 0; the patterns are a fixed list."""
    m: Column = F.lit(0)
    for i, p in enumerate(patterns, 1):
        m = F.when(F.col(value).rlike(f"(?i){p}"), F.lit(i)).otherwise(m)
    return left.withColumn("match", m)


def pairs_within(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, a, b: the unordered pairs of keys of each group; for groups that are small by their nature, so there must be some."""
    if not by:
        raise ValueError("pairs of a whole table are not built")
    a = df.select(*by, F.col(key).alias("a"))
    b = df.select(*by, F.col(key).alias("b"))
    return a.join(b, by).where("a < b")


def by_position(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], by: list[str]) -> DataFrame:
    """Row i of each group of ``a`` beside row i of the same group of ``b``."""
    pa = a.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order_a)))
    pb = b.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order_b)))
    return pa.join(pb, [*by, "pos"])


def lookup_all(df: DataFrame, lookups: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins on several code columns, and ``complete``: whether every one was found.  Each lookup is (table, key column there, code column here)."""
    d, found = df, F.lit(True)
    for i, (table, key, code) in enumerate(lookups):
        t = table.withColumn(f"_hit{i}", F.lit(True))
        d = d.join(t, d[code] == t[key], "left")
        found &= F.coalesce(F.col(f"_hit{i}"), F.lit(False))
    return d.withColumn("complete", found).drop(*[f"_hit{i}" for i in range(len(lookups))])


def differences(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """key and what differs: 'added', 'removed' or 'changed'."""
    left = a.select(*key, F.struct(*values).alias("_a"), F.lit(1).alias("_ia"))
    right = b.select(*key, F.struct(*values).alias("_b"), F.lit(1).alias("_ib"))
    j = left.join(right, key, "full")
    kind = F.when(F.col("_ia").isNull(), "added").when(F.col("_ib").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.withColumn("change", kind).where("change is not null").select(*key, "change")
