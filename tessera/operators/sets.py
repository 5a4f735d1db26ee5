"""Set operations: ordered union, row append with differing columns, and regions of voxels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_union(a: DataFrame, b: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with ``place``: those of a in their order, then the new ones of b."""
    both = a.select(value, F.struct(F.lit(0).alias("s"), F.col(pos).cast("long").alias("p")).alias("o")).unionByName(b.select(value, F.struct(F.lit(1).alias("s"), F.col(pos).cast("long").alias("p")).alias("o")))
    first = both.groupBy(value).agg(F.min("o").alias("o"))
    return first.select(value, F.col("o.s").alias("source"), F.col("o.p").alias("place"))


def append_rows(*dfs: DataFrame) -> DataFrame:
    """Rows of all inputs; a column that one lacks is null there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def intersect_regions(members: DataFrame, region: str, voxel: list[str], names: list[str]) -> DataFrame:
    """The voxels that all named regions hold."""
    m = members.where(F.col(region).isin(names)).select(region, *voxel).distinct()
    return m.groupBy(*voxel).agg(F.count("*").alias("_n")).where(F.col("_n") == len(names)).select(*voxel)


def unite_regions(members: DataFrame, region: str, voxel: list[str], names: list[str]) -> DataFrame:
    return members.where(F.col(region).isin(names)).select(*voxel).distinct()


def subtract_regions(members: DataFrame, region: str, voxel: list[str], keep: str, drop: list[str]) -> DataFrame:
    """The first region's voxels that none of the others holds."""
    a = members.where(F.col(region) == keep).select(*voxel).distinct()
    return a.join(members.where(F.col(region).isin(drop)).select(*voxel).distinct(), voxel, "left_anti")


def overlap_regions(members: DataFrame, region: str, voxel: list[str], names: list[str], share: float) -> DataFrame:
    """Voxels that at least that share (rounded up) of the named regions holds, with their number."""
    need = -int(-len(names) * share // 1)
    m = members.where(F.col(region).isin(names)).select(region, *voxel).distinct()
    return m.groupBy(*voxel).agg(F.count("*").alias("n_regions")).where(F.col("n_regions") >= need)


def restrict_box(df: DataFrame, axes: list[str], low: list[float], high: list[float]) -> DataFrame:
    ok = F.lit(True)
    for a, lo, hi in zip(axes, low, high, strict=True):
        ok &= F.col(a).between(lo, hi)
    return df.where(ok)


def restrict_sphere(df: DataFrame, axes: list[str], centre: list[float], radius: float) -> DataFrame:
    d = reduce(lambda x, y: x + y, [(F.col(a) - c) * (F.col(a) - c) for a, c in zip(axes, centre, strict=True)])
    return df.where(d <= radius * radius)


def region_summary(members: DataFrame, region: str, voxel: list[str], values: DataFrame, value: str) -> DataFrame:
    """Mean, peak and size of a map inside every region."""
    j = members.select(region, *voxel).distinct().join(values, voxel)
    peak = F.max(F.struct(F.col(value), *[(-F.col(v)).alias(v) for v in voxel]))
    out = j.groupBy(region).agg(F.avg(value).alias("mean"), peak.alias("_p"), F.count("*").alias("n"))
    return out.select(region, "mean", F.col(f"_p.{value}").alias("peak"), *[(-F.col(f"_p.{v}")).alias(f"peak_{v}") for v in voxel], "n")
