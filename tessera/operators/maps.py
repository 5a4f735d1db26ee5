"""Methods of masks, maps, regions, volumes and meshes as transformations of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import Col, col, good


def flexible_mask(x: Col, threshold: float, side: int = 1, flags: bool = False) -> Column:
    """``x`` where it is at least (1), equal to (0) or at most (-1) the threshold, else 0; or whether it is."""
    v = good(x)
    ok = F.coalesce({1: v >= threshold, 0: v == threshold, -1: v <= threshold}[side], F.lit(False))
    return ok if flags else F.when(ok, v).otherwise(F.lit(0.0))


def threshold_colour(x: Col, low: float, high: float, lower: Col = 0, upper: Col = 255) -> Column:
    """Where a thresholded value lies between the two thresholds, from 0 to 1, with its sign; 0 below the lower one."""
    v = good(x)
    share = F.least(F.lit(1.0), (F.abs(v) - low) / (high - low))
    return F.coalesce(F.when(F.abs(v) >= low, share * F.signum(v)), F.lit(0.0))


def intensity_mask(samples: DataFrame, voxel: list[str], x: str, share: float) -> DataFrame:
    """The voxels whose mean is at least that share of the mean over all voxels' means."""
    m = samples.groupBy(*voxel).agg(F.avg(good(x)).alias("mean"))
    return m.crossJoin(F.broadcast(m.agg(F.avg("mean").alias("_all")))).where(F.col("mean") >= share * F.col("_all")).drop("_all")


def apply_mask(df: DataFrame, mask: DataFrame, voxel: list[str], value: str) -> DataFrame:
    """The rows at voxels where the mask is above 0."""
    return df.join(mask.where(F.col(value) > 0).select(*voxel).distinct(), voxel, "left_semi")


def mask_of_map(df: DataFrame, x: str, threshold: float, out: str = "mask") -> DataFrame:
    """1 where the map's value is that large on either side, else 0."""
    return df.withColumn(out, F.coalesce((F.abs(good(x)) >= threshold).cast("int"), F.lit(0)))


def combine_maps(df: DataFrame, voxel: list[str], x: str) -> DataFrame:
    """The mean over several maps at each place, of good values, and how many it has."""
    return df.groupBy(*voxel).agg(F.coalesce(F.avg(good(x)), F.lit(0.0)).alias(x), F.count(good(x)).alias("n_maps"))


def subset_of_maps(df: DataFrame, map_no: str, chosen: list[int], out: str = "place") -> DataFrame:
    """The chosen maps in the order stated."""
    place = F.array_position(F.array(*[F.lit(i) for i in chosen]), F.col(map_no).cast("int"))
    return df.where(F.col(map_no).isin(*chosen)).withColumn(out, place.cast("int"))


def volume(samples: DataFrame, t: str, number: int) -> DataFrame:
    """One volume of a series."""
    return samples.where(F.col(t) == number)


def frame(df: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """The rows inside a box, with coordinates that begin at 0 there."""
    for a, (low, high) in box.items():
        df = df.where(F.col(a).between(low, high)).withColumn(a, F.col(a) - low)
    return df


def least_box(df: DataFrame, axes: list[str], x: str) -> DataFrame:
    """The smallest box that holds every value other than 0, as one row."""
    some = df.where(F.coalesce(good(x), F.lit(0.0)) != 0)
    return some.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def limit_values(df: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """Values cut to a range and scaled to 0 .. 225."""
    cut = F.least(F.greatest(F.col(x), F.lit(float(low))), F.lit(float(high)))
    return df.withColumn(x, F.round(225 * (cut - low) / (high - low)))


def local_coherence(series: DataFrame, voxel: list[str], t: str, x: str) -> DataFrame:
    """The mean correlation of a voxel's series with those of its face neighbours: joins on shifted keys."""
    total = None
    for a in voxel:
        other = series.select(*[(F.col(v) - 1 if v == a else F.col(v)).alias(v) for v in voxel], t, F.col(x).alias("_y"))
        r = series.join(other, [*voxel, t]).groupBy(*voxel).agg(F.corr(x, "_y").alias("r"))
        both = r.union(r.select(*[(F.col(v) + 1 if v == a else F.col(v)).alias(v) for v in voxel], "r"))
        total = both if total is None else total.union(both)
    return total.where(F.col("r").isNotNull()).groupBy(*voxel).agg(F.avg("r").alias("coherence"), F.count("*").alias("n"))


def slice_of(df: DataFrame, axis: str, at: float, tolerance: float = 0.5) -> DataFrame:
    """One slice: the rows nearest to a coordinate of an axis, without it."""
    return df.where((F.col(axis) >= at - tolerance) & (F.col(axis) < at + tolerance)).drop(axis)


def time_course_of_map(maps: DataFrame, map_no: str, members: DataFrame, voxel: list[str], x: str) -> DataFrame:
    """voxel, r: the correlation, across maps, of every voxel with a region's mean."""
    mean = maps.join(members.select(*voxel).distinct(), voxel).groupBy(map_no).agg(F.avg(x).alias("_m"))
    j = maps.join(mean, map_no)
    return j.groupBy(*voxel).agg(F.corr(x, "_m").alias("r"), F.count("*").alias("n"))


# --- regions: (region, x, y, z) ---


def region_names(members: DataFrame, region: str) -> DataFrame:
    return members.select(region).distinct()


def region_voxels(members: DataFrame, axes: list[str], region: str, names: list | None = None) -> DataFrame:
    """The voxels of the chosen regions (all by default), each once, with the number of regions that hold it."""
    d = members if names is None else members.where(F.col(region).isin(*names))
    return d.groupBy(*axes).agg(F.count_distinct(region).alias("n_regions"))


def region_mask(members: DataFrame, grid: DataFrame, axes: list[str], out: str = "mask") -> DataFrame:
    """A grid with 1 at every place that some region holds, else 0."""
    m = members.select(*axes).distinct().withColumn(out, F.lit(1))
    return grid.select(*axes).join(m, axes, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def system_coordinates(df: DataFrame, axes: list[str], centre: float = 128.0) -> DataFrame:
    """Talairach coordinates as system coordinates, or back: centre less the coordinate, axes in the order y, z, x."""
    x, y, z = axes
    new = {x: centre - F.col(y), y: centre - F.col(z), z: centre - F.col(x)}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def sorted_voxels(members: DataFrame, region: str, axes: list[str], out: str = "place") -> DataFrame:
    """Voxels numbered by their distance from their region's centre, ties by coordinates."""
    from .windows import beside

    d = beside(members, [region], **{f"_c{a}": F.avg(a) for a in axes})
    total = sum(((F.col(a) - F.col(f"_c{a}")) * (F.col(a) - F.col(f"_c{a}")) for a in axes), F.lit(0.0))
    d = d.withColumn("distance", F.round(F.sqrt(total), 9)).drop(*[f"_c{a}" for a in axes])
    return d.withColumn(out, F.row_number().over(Window.partitionBy(region).orderBy("distance", *axes)))


def points_in_mask(points: DataFrame, mask: DataFrame, axes: list[str], step: float) -> DataFrame:
    """Points whose nearest grid place is in a mask."""
    cells = mask.select(*[F.col(a).cast("long").alias(f"_{a}") for a in axes]).distinct()
    d = points
    for a in axes:
        d = d.withColumn(f"_{a}", F.floor(F.col(a) / step + 0.5))
    return d.join(cells, [f"_{a}" for a in axes], "left_semi").drop(*[f"_{a}" for a in axes])


# --- meshes: (a, b) edges of vertices ---


def neighbours_to_degree(edges: DataFrame, degree: int) -> DataFrame:
    """vertex, neighbour, degree: who is reached in that many steps at most, with the fewest; a mesh's vertices have few neighbours."""
    step = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    reached = step.select(F.col("a").alias("vertex"), F.col("b").alias("neighbour"), F.lit(1).alias("degree"))
    last = reached
    for k in range(2, degree + 1):
        onward = last.select("vertex", F.col("neighbour").alias("a")).join(step, "a").select("vertex", F.col("b").alias("neighbour")).where("vertex <> neighbour").distinct()
        last = onward.join(reached, ["vertex", "neighbour"], "left_anti").withColumn("degree", F.lit(k))
        reached = reached.union(last)
    return reached


def vertex_density(edges: DataFrame, coordinates: DataFrame, vertex: str, axes: list[str]) -> DataFrame:
    """vertex and the mean distance to its direct neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    p = coordinates.select(F.col(vertex).alias("a"), *axes)
    q = coordinates.select(F.col(vertex).alias("b"), *[F.col(c).alias(f"_{c}") for c in axes])
    total = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in axes), F.lit(0.0))
    return both.join(p, "a").join(q, "b").groupBy(F.col("a").alias(vertex)).agg(F.avg(F.sqrt(total)).alias("distance"), F.count("*").alias("n"))


def combine_meshes(a: DataFrame, b: DataFrame, vertex: str) -> DataFrame:
    """The vertices of two meshes as one: those of the second are numbered after the first's."""
    last = F.broadcast(a.agg(F.coalesce(F.max(vertex), F.lit(-1)).alias("_last")))
    return a.unionByName(b.crossJoin(last).withColumn(vertex, F.col(vertex) + F.col("_last") + 1).drop("_last"))
