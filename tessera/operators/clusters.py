"""Clusters on grids: neighbours, connected components, cluster tables and morphology.

A volume is a table of cells, and neighbourhood is an equi-join on shifted
coordinates, so a volume of any size spreads over the cluster.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import good
from ..store import written


def offsets(axes: int, connect: int) -> list[tuple[int, ...]]:
    """Neighbour offsets: cells that differ in at most ``connect`` axes (1 faces, 2 edges, 3 corners)."""
    return [o for o in product((-1, 0, 1), repeat=axes) if 0 < sum(map(abs, o)) <= connect]


def neighbours(cells: DataFrame, axes: list[str], connect: int = 1, keys: list[str] = ()) -> DataFrame:
    """[keys,] axes and n_axes: every pair of neighbouring cells (of one key), both ways."""
    shift = F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in offsets(len(axes), connect)])
    moved = cells.select(*keys, *axes, F.explode(shift).alias("o"))
    moved = moved.select(*keys, *axes, *[(F.col(a) + F.col(f"o.d{i}")).alias(f"n_{a}") for i, a in enumerate(axes)])
    there = cells.select(*keys, *[F.col(a).alias(f"n_{a}") for a in axes])
    return moved.join(there, [*keys, *[f"n_{a}" for a in axes]], "left_semi")


def label_components(cells: DataFrame, axes: list[str], connect: int = 1, rounds: int = 60, keys: list[str] = ()) -> DataFrame:
    """Every cell with ``cluster``: the smallest cell of its connected component, as a struct of its coordinates.  With ``keys``, many maps are labelled at once: cells of different keys are never neighbours, and the struct begins with the keys.

    Large-star and small-star rounds on the neighbour edges; each is written,
    and the number of rounds grows with the logarithm of a cluster's length.
    """
    node = F.struct(*keys, *axes)
    pairs = neighbours(cells, axes, connect, keys)
    e = pairs.select(node.alias("u"), F.struct(*keys, *[F.col(f"n_{a}").alias(a) for a in axes]).alias("v")).where("u > v")
    e = written(e, "edges")
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = written(small.where("u <> v").distinct(), "edges")
        if new.count() == e.count() and new.exceptAll(e).isEmpty():
            break
        e = new
    found = e.select(F.col("u").alias("_n"), F.col("v").alias("_c"))
    return cells.withColumn("_n", node).join(found, "_n", "left").withColumn("cluster", F.coalesce("_c", "_n")).drop("_n", "_c")


def cluster_table(values: DataFrame, axes: list[str], x: str, threshold: float, least: int = 1, connect: int = 1) -> DataFrame:
    """Size, peak and its place, mean and centre of gravity of every cluster above the threshold."""
    lab = label_components(values.where(F.col(x) >= threshold).select(*axes, x), axes, connect)
    peak = F.max(F.struct(F.col(x), *[(-F.col(a)).alias(a) for a in axes]))
    t = lab.groupBy("cluster").agg(F.count("*").alias("size"), peak.alias("p"), F.avg(x).alias("mean"), *[(F.sum(F.col(a) * F.col(x)) / F.sum(x)).alias(f"cog_{a}") for a in axes])
    return t.where(F.col("size") >= least).select("size", F.col(f"p.{x}").alias("peak"), *[(-F.col(f"p.{a}")).alias(f"peak_{a}") for a in axes], "mean", *[f"cog_{a}" for a in axes])


def _higher(a: list, b: list) -> Column:
    """Whether (value, cell) a comes before b: more value, or the lesser cell at equal ones."""
    same = F.lit(False)
    for x, y in zip(a[:0:-1], b[:0:-1], strict=True):
        same = (x < y) | ((x == y) & same)
    return (a[0] > b[0]) | ((a[0] == b[0]) & same)


def basins(values: DataFrame, axes: list[str], x: str, connect: int = 3, least: int = 1, apart: float = 0.0) -> DataFrame:
    """Every cell with the peak (``peak_`` axes) that its steepest ascent leads to, by highest neighbours (of equal ones the least cell).

    Cells point to their highest neighbour, and pointers double until they end
    in peaks, so rounds grow with the logarithm of a path.  Basins of fewer than
    ``least`` cells, and those whose peak is nearer than ``apart`` to that of a
    higher neighbour, then join the higher-peaked neighbour over the highest
    pass (the lower of two adjacent cells; the nearest such peak for those too
    near), round by round until none is left that has one.
    """
    v = values.where(F.col(x).isNotNull()).select(*axes, F.col(x).cast("double").alias("_v"))
    there = v.select(*[F.col(a).alias(f"n_{a}") for a in axes], F.col("_v").alias("_w"))
    pairs = written(neighbours(v, axes, connect).join(v, axes).join(there, [f"n_{a}" for a in axes]), "pairs")
    up = pairs.where(_higher([F.col("_w"), *[F.col(f"n_{a}") for a in axes]], [F.col("_v"), *[F.col(a) for a in axes]]))
    best = up.groupBy(*axes).agg(F.max(F.struct(F.col("_w"), *[(-F.col(f"n_{a}")).alias(f"n_{a}") for a in axes])).alias("b"))
    to = v.join(best, axes, "left").select(*axes, "_v", *[F.coalesce(-F.col(f"b.n_{a}"), F.col(a)).alias(f"peak_{a}") for a in axes])
    to = _followed(written(to, "ascent"), axes)
    while least > 1 or apart > 0:
        size = to.groupBy(*[f"peak_{a}" for a in axes]).agg(F.count("*").alias("_n"), F.max("_v").alias("_top"))
        own = to.select(*axes, *[F.col(f"peak_{a}").alias(f"p_{a}") for a in axes])
        other = to.select(*[F.col(a).alias(f"n_{a}") for a in axes], *[F.col(f"peak_{a}").alias(f"q_{a}") for a in axes])
        differ = F.lit(False)
        for a in axes:
            differ |= F.col(f"p_{a}") != F.col(f"q_{a}")
        passes = pairs.join(own, axes).join(other, [f"n_{a}" for a in axes]).where(differ).groupBy(*[f"{e}_{a}" for e in "pq" for a in axes]).agg(F.max(F.least("_v", "_w")).alias("_pass"))
        mine = size.select(*[F.col(f"peak_{a}").alias(f"p_{a}") for a in axes], F.col("_n").alias("_pn"), F.col("_top").alias("_pt"))
        theirs = size.select(*[F.col(f"peak_{a}").alias(f"q_{a}") for a in axes], F.col("_top").alias("_qt"))
        edges = passes.join(mine, [f"p_{a}" for a in axes]).join(theirs, [f"q_{a}" for a in axes])
        edges = edges.where(_higher([F.col("_qt"), *[F.col(f"q_{a}") for a in axes]], [F.col("_pt"), *[F.col(f"p_{a}") for a in axes]]))
        far = F.lit(0.0)
        for a in axes:
            far = far + (F.col(f"p_{a}") - F.col(f"q_{a}")) * (F.col(f"p_{a}") - F.col(f"q_{a}"))
        near = far < apart * apart
        rank = F.struct(near.alias("near"), F.when(near, -far).otherwise(F.col("_pass")).alias("by"), F.col("_qt"), *[(-F.col(f"q_{a}")).alias(f"q_{a}") for a in axes])
        joins = edges.where((F.col("_pn") < least) | near).groupBy(*[f"p_{a}" for a in axes]).agg(F.max(rank).alias("b"))
        joins = written(joins.select(*[F.col(f"p_{a}").alias(f"from_{a}") for a in axes], *[(-F.col(f"b.q_{a}")).alias(f"to_{a}") for a in axes]), "joins")
        if joins.isEmpty():
            break
        moved = to.join(joins.withColumnsRenamed({f"from_{a}": f"peak_{a}" for a in axes}), [f"peak_{a}" for a in axes], "left")
        step = moved.select(*axes, "_v", *[F.coalesce(f"to_{a}", f"peak_{a}").alias(f"peak_{a}") for a in axes])
        to = _followed(written(step, "ascent"), axes)
    return values.join(to.drop("_v"), axes, "left")


def _followed(to: DataFrame, axes: list[str]) -> DataFrame:
    """Pointers (axes -> ``peak_`` axes) as pointers to where they end, by doubling; a cell that points to itself is an end."""
    while True:
        ahead = to.select(*[F.col(a).alias(f"peak_{a}") for a in axes], *[F.col(f"peak_{a}").alias(f"_to_{a}") for a in axes])
        d = to.join(ahead, [f"peak_{a}" for a in axes]).select(*axes, "_v", *[f"peak_{a}" for a in axes], *[f"_to_{a}" for a in axes])
        moved = F.lit(False)
        for a in axes:
            moved |= F.col(f"_to_{a}") != F.col(f"peak_{a}")
        d = written(d.withColumn("_moved", moved), "ascent")
        to = d.select(*axes, "_v", *[F.col(f"_to_{a}").alias(f"peak_{a}") for a in axes])
        if d.where("_moved").isEmpty():
            return to


def flipped_clusters(residuals: DataFrame, subject: str, axes: list[str], x: str, threshold: float, flips: int = 200, connect: int = 1, seed: int = 1) -> DataFrame:
    """b (0 is the data, the others random sign flips of whole subjects), cells and largest: of the map of one-sample t over subjects, the cells at ``threshold`` or more and the size of their largest cluster.

    A subject's signs depend on its number alone.  Sums of all flips come from
    one pass, and the maps are labelled together under the key b.  Bad values
    are left out; a t that can't be told is below any threshold.
    """
    from .stats import _drawn, draws

    every = np.arange(flips + 1)

    def signs(key):
        s = np.where(draws(key, every, seed) < 0.5, -1.0, 1.0)
        s[0] = 1.0
        return s

    d = residuals.select(subject, *axes, good(x).alias("_x")).where("_x is not null")
    sums = _drawn(d, axes, subject, "_x", every, signs).select(*axes, "b", F.col("wx").alias("s"))
    each = d.where(F.col(subject).isNotNull()).groupBy(*axes).agg(F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("ss"))
    m = F.col("s") / F.col("n")
    t = F.try_divide(m, F.sqrt(F.try_divide(F.try_divide(F.col("ss") - F.col("n") * m * m, F.col("n") - 1), F.col("n"))))
    above = written(sums.join(each, axes).where(t >= threshold).select("b", *axes), "above")
    sizes = label_components(above, axes, connect, keys=["b"]).groupBy("b", "cluster").agg(F.count("*").alias("c"))
    found = sizes.groupBy("b").agg(F.sum("c").alias("cells"), F.max("c").alias("largest"))
    maps = residuals.sparkSession.range(flips + 1).select(F.col("id").cast("int").alias("b"))
    return maps.join(found, "b", "left").select("b", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("largest", F.lit(0)).alias("largest"))


def required_size(flipped: DataFrame, level: float = 0.05) -> DataFrame:
    """The least size that the largest cluster reaches in at most ``level`` of the flips, and the corrected p of the data's own largest."""
    n = flipped.where("b > 0").groupBy("largest").agg(F.count("*").alias("c"))
    at_least = n.withColumn("_up", F.sum("c").over(Window.orderBy(F.desc("largest")))).crossJoin(F.broadcast(flipped.where("b > 0").agg(F.count("*").alias("_n"))))
    size = at_least.agg((F.coalesce(F.max(F.when(F.col("_up") > level * F.col("_n"), F.col("largest"))), F.lit(0)) + 1).alias("size"))
    own = flipped.where("b = 0").select(F.col("largest").alias("_own"))
    p = flipped.crossJoin(F.broadcast(own)).agg((F.count_if(F.col("largest") >= F.col("_own")) / F.count("*")).alias("p"))
    return size.crossJoin(F.broadcast(p))


def local_maxima(values: DataFrame, axes: list[str], x: str, connect: int = 1) -> DataFrame:
    """Cells above all their neighbours."""
    shift = F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in offsets(len(axes), connect)])
    near = values.select(*axes, x, F.explode(shift).alias("o")).select(*[(F.col(a) + F.col(f"o.d{i}")).alias(a) for i, a in enumerate(axes)], F.col(x).alias("_v"))
    top = near.groupBy(*axes).agg(F.max("_v").alias("_v"))
    return values.join(top, axes, "left").where(F.col("_v").isNull() | (F.col(x) > F.col("_v"))).drop("_v")


def dilate(cells: DataFrame, axes: list[str], connect: int = 1) -> DataFrame:
    """The cells and all their neighbours."""
    shift = F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in [(0,) * len(axes), *offsets(len(axes), connect)]])
    return cells.select(*axes, F.explode(shift).alias("o")).select(*[(F.col(a) + F.col(f"o.d{i}")).alias(a) for i, a in enumerate(axes)]).distinct()


def erode(cells: DataFrame, axes: list[str], connect: int = 1) -> DataFrame:
    """The cells all of whose neighbours are cells, too."""
    n = neighbours(cells, axes, connect).groupBy(*axes).agg(F.count("*").alias("_n"))
    return n.where(F.col("_n") == len(offsets(len(axes), connect))).select(*axes)


def smooth_axis(values: DataFrame, axes: list[str], axis: str, x: str, kernel: list[float]) -> DataFrame:
    """A separable smoothing step along one axis; cells beyond the grid are left out and the kernel is renormalised."""
    half = len(kernel) // 2
    k = F.array(*[F.struct(F.lit(i - half).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(kernel)])
    spread = values.select(*axes, x, F.explode(k).alias("k")).withColumn(axis, F.col(axis) + F.col("k.d"))
    s = spread.groupBy(*axes).agg((F.sum(F.col(x) * F.col("k.w")) / F.sum("k.w")).alias(x))
    return s.join(values.select(*axes), axes, "left_semi")


def smooth(values: DataFrame, axes: list[str], x: str, kernel: list[float]) -> DataFrame:
    return reduce(lambda d, a: smooth_axis(d, axes, a, x, kernel), axes, values)


def trilinear(values: DataFrame, axes: list[str], x: str, points: DataFrame, key: str) -> DataFrame:
    """The multilinear interpolation of a grid at points: an equi-join on the corners of each point's cell; a missing corner counts as 0."""
    n = len(axes)
    corner = F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in product((0, 1), repeat=n)])
    p = points.select(key, *axes, F.explode(corner).alias("o"))
    w = F.lit(1.0)
    for i, a in enumerate(axes):
        f = F.col(a) - F.floor(F.col(a))
        w = w * F.when(F.col(f"o.d{i}") == 1, f).otherwise(1 - f)
    p = p.withColumn("_w", w).select(key, "_w", *[(F.floor(F.col(a)) + F.col(f"o.d{i}")).cast("long").alias(a) for i, a in enumerate(axes)]).where("_w > 0")
    v = values.select(*[F.col(a).cast("long").alias(a) for a in axes], F.col(x).alias("_x"))
    return p.join(v, axes, "left").groupBy(key).agg(F.sum(F.col("_w") * F.coalesce("_x", F.lit(0.0))).alias(x))


def ranked_clusters(table: DataFrame, k: int) -> DataFrame:
    """The k largest clusters; ties by peak."""
    return table.orderBy(F.desc("size"), F.desc("peak"), *[c for c in table.columns if c.startswith("peak_")]).limit(k)
