"""Neighbourhood analysis, meshes and Monte-Carlo cluster thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import written
from .joins import radius_join


def neighbourhood_statistics(cells: DataFrame, axes: list[str], x: str, radius: float) -> DataFrame:
    """axes, mean, sd and number of the values within the radius of each cell."""
    j = radius_join(cells.select(*axes), cells.select(*axes, x), axes, radius)
    return j.groupBy(*axes).agg(F.avg(f"other_{x}").alias("mean"), F.stddev_samp(f"other_{x}").alias("sd"), F.count("*").alias("n"))


def nearest_mean_accuracy(v: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """Share of samples whose class mean, taken without their fold, is the nearest."""
    right = 0
    for f in np.unique(fold):
        test = fold == f
        labels = np.unique(y[~test])
        if not labels.size:
            continue
        means = np.stack([v[~test & (y == k)].mean(axis=0) for k in labels])
        at = ((v[test][:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        right += int((labels[at] == y[test]).sum())
    return right / max(1, y.size)


def searchlight(samples: DataFrame, axes: list[str], sample: str, condition: str, fold: str, x: str, radius: float, measure=nearest_mean_accuracy) -> DataFrame:
    """axes, measure and n_features of every centre: ``measure(features, conditions, folds)`` over the cells within the radius.

    A centre's neighbours are one group; their number is bounded by the radius.
    Samples that lack a cell have 0 there.
    """
    centres = samples.select(*axes).distinct()
    near = radius_join(centres, samples.select(*axes).distinct(), axes, radius).drop("distance")
    j = near.join(samples.select(*[F.col(a).alias(f"other_{a}") for a in axes], sample, condition, fold, x), [f"other_{a}" for a in axes])
    schema = ", ".join(f"`{a}` {samples.schema[a].dataType.simpleString()}" for a in axes) + ", measure double, n_features int"

    def run(key, pdf):
        wide = pdf.pivot_table(index=[sample, condition, fold], columns=[f"other_{a}" for a in axes], values=x, aggfunc="mean", fill_value=0.0).sort_index()
        idx = wide.index
        m = measure(wide.to_numpy(float), idx.get_level_values(1).to_numpy(), idx.get_level_values(2).to_numpy())
        return pd.DataFrame([[*key, float(m), wide.shape[1]]], columns=[*axes, "measure", "n_features"])

    return j.groupBy(*axes).applyInPandas(run, schema)


def mesh_edges(faces: DataFrame) -> DataFrame:
    """a, b: the undirected edges of triangles (a, b, c)."""
    e = faces.select(F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))])).alias("e"))
    return e.select("e.a", "e.b").where("a <> b").distinct()


def edge_lengths(edges: DataFrame, vertices: DataFrame, key: str, axes: list[str]) -> DataFrame:
    p = vertices.select(F.col(key).alias("a"), *[F.col(x).alias(f"p_{x}") for x in axes])
    q = vertices.select(F.col(key).alias("b"), *[F.col(x).alias(f"q_{x}") for x in axes])
    total = sum(((F.col(f"p_{x}") - F.col(f"q_{x}")) * (F.col(f"p_{x}") - F.col(f"q_{x}")) for x in axes), F.lit(0.0))
    return edges.join(p, "a").join(q, "b").select("a", "b", F.sqrt(total).alias("length"))


def smooth_mesh(values: DataFrame, edges: DataFrame, vertex: str, xs: list[str], weight: float, rounds: int, keys: list[str] = (), tolerance: float | None = None) -> DataFrame:
    """[keys,] vertex and xs, each round (own + weight x the neighbours' mean) / (1 + weight), for ``rounds`` rounds or until no value moves by more than ``tolerance``.

    ``edges`` (a, b) are those of ``mesh_edges``; values come by key (the times of
    series, say), and coordinates of the vertices smooth the mesh itself.
    Vertices send their values along the edges, which are summed before the
    shuffle; every round is written.  Missing values send nothing and stay
    missing; a vertex without a neighbour that has one keeps its own.
    """
    both = written(edges.select(F.col("a").alias("_to"), F.col("b").alias(vertex)).unionByName(edges.select(F.col("b").alias("_to"), F.col("a").alias(vertex))), "edges")
    now = values.select(*keys, vertex, *[F.col(x).cast("double").alias(x) for x in xs])
    for _ in range(rounds):
        sent = now.join(both, vertex).groupBy(*keys, "_to").agg(*[F.avg(x).alias(f"_m_{x}") for x in xs]).withColumnRenamed("_to", vertex)
        new = [F.when(F.col(f"_m_{x}").isNull(), F.col(x)).otherwise((F.col(x) + weight * F.col(f"_m_{x}")) / (1 + weight)) for x in xs]
        moved = F.greatest(F.lit(0.0), *[F.coalesce(F.abs(n - F.col(x)), F.lit(0.0)) for n, x in zip(new, xs, strict=True)])
        step = written(now.join(sent, [*keys, vertex], "left").select(*keys, vertex, *[n.alias(x) for n, x in zip(new, xs, strict=True)], moved.alias("_moved")), "smoothed")
        now = step.drop("_moved")
        if tolerance is not None and step.where(F.col("_moved") > tolerance).isEmpty():
            break
    return now


def vertex_normals(faces: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """key and the unit sum of its triangles' normals (x, y, z)."""
    f = faces
    for k in "abc":
        f = f.join(vertices.select(F.col(key).alias(k), *[F.col(x).alias(f"{k}{x}") for x in "xyz"]), k)
    u = {x: F.col(f"b{x}") - F.col(f"a{x}") for x in "xyz"}
    v = {x: F.col(f"c{x}") - F.col(f"a{x}") for x in "xyz"}
    n = F.struct((u["y"] * v["z"] - u["z"] * v["y"]).alias("x"), (u["z"] * v["x"] - u["x"] * v["z"]).alias("y"), (u["x"] * v["y"] - u["y"] * v["x"]).alias("z"))
    s = f.select(n.alias("n"), F.explode(F.array("a", "b", "c")).alias(key)).groupBy(key).agg(*[F.sum(f"n.{x}").alias(x) for x in "xyz"])
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return s.select(key, *[F.coalesce(F.try_divide(F.col(x), size), F.lit(0.0)).alias(x) for x in "xyz"])


def _label(mask: np.ndarray) -> np.ndarray:
    """Sizes of the face-connected components of a mask."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = lab.copy()
        for ax in range(mask.ndim):
            for s in (1, -1):
                moved = np.roll(lab, s, ax)
                edge = [slice(None)] * mask.ndim
                edge[ax] = 0 if s == 1 else -1
                moved[tuple(edge)] = 0
                new = np.where(mask, np.maximum(new, moved), 0)
        if np.array_equal(new, lab):
            return np.unique(lab[lab > 0], return_counts=True)[1]
        lab = new


def cluster_size_simulation(spark: SparkSession, shape: tuple[int, ...], fwhm: float, p: float, iterations: int = 1000, seed: int = 1, slices: int = 8) -> DataFrame:
    """size, clusters, p_voxel-free share at or above it, maps whose largest cluster has it, and alpha: the share of maps with a cluster that large.

    Every iteration draws from its own seed, so a retried task repeats it; only
    counts per size are shuffled.
    """
    cut = float(np.sqrt(2) * _erfinv(1 - 2 * p))

    def run(it):
        sigma = fwhm / 2.3548200450309493
        f = [np.exp(-2 * (np.pi * np.fft.fftfreq(n) * sigma) ** 2) for n in shape]
        gain = f[0]
        for g in f[1:]:
            gain = np.multiply.outer(gain, g)
        for pdf in it:
            rows = []
            for i in pdf["id"]:
                z = np.random.default_rng([seed, int(i)]).normal(size=shape)
                z = np.fft.ifftn(np.fft.fftn(z) * gain).real
                z = (z - z.mean()) / z.std()
                sizes = _label(z >= cut)
                top = int(sizes.max()) if sizes.size else 0
                u, n = np.unique(sizes, return_counts=True)
                rows += [(int(a), int(b), int(a == top)) for a, b in zip(u, n, strict=True)] or [(0, 0, 1)]
            yield pd.DataFrame(rows, columns=["size", "n", "largest"])

    c = spark.range(0, iterations, 1, slices).mapInPandas(run, "size int, n long, largest long").groupBy("size").agg(F.sum("n").alias("clusters"), F.sum("largest").alias("largest"))
    above = c.select(F.col("size").alias("s"), F.col("clusters").alias("c"), F.col("largest").alias("l"))
    # one row a size: at most as many as there are cells
    j = c.join(above, F.col("s") >= F.col("size")).groupBy("size", "clusters", "largest").agg(F.sum("c").alias("at_least"), (F.sum("l") / iterations).alias("alpha"))
    return j.where("size > 0").select("size", "clusters", "at_least", "largest", "alpha")


def _erfinv(y: float) -> float:
    import math

    lo, hi = -6.0, 6.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < y else (lo, mid)
    return (lo + hi) / 2


def flood(cells: DataFrame, axes: list[str], seed: dict[str, int], connect: int = 1) -> DataFrame:
    """The cells connected with the seed."""
    from .clusters import label_components

    lab = label_components(cells, axes, connect)
    at = F.lit(True)
    for a, v in seed.items():
        at &= F.col(a) == v
    return lab.join(F.broadcast(lab.where(at).select("cluster").limit(1)), "cluster", "left_semi").select(*axes)


def distance_transform(cells: DataFrame, axes: list[str], most: int) -> DataFrame:
    """axes and depth: how often a cell survives erosion by its face neighbours, up to ``most``; one equi-join a layer."""
    from ..store import written
    from .clusters import erode

    d, layer = cells.select(*axes, F.lit(1).alias("depth")), cells.select(*axes)
    for k in range(2, most + 1):
        layer = written(erode(layer, axes), "layer")
        if layer.isEmpty():
            break
        d = d.union(layer.select(*axes, F.lit(k).alias("depth")))
    return d.groupBy(*axes).agg(F.max("depth").alias("depth"))


def match_histogram(values: DataFrame, x: str, reference: DataFrame, y: str, steps: int = 256) -> DataFrame:
    """``values`` with ``matched``: each value at the reference's value of the same share, through ``steps`` quantiles of either side."""
    q = [i / steps for i in range(steps + 1)]
    a = values.agg(F.percentile(x, F.array(*[F.lit(v) for v in q])).alias("_a"))
    b = reference.agg(F.percentile(y, F.array(*[F.lit(v) for v in q])).alias("_b"))
    d = values.crossJoin(F.broadcast(a.crossJoin(b)))
    i = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.size(F.filter("_a", lambda v: v <= F.col(x))) - 1))
    lo, hi = F.get("_a", i), F.get("_a", i + 1)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col(x) - lo, hi - lo), F.lit(0.0))))
    return d.withColumn("matched", F.get("_b", i) + share * (F.get("_b", i + 1) - F.get("_b", i))).drop("_a", "_b")


def mean_dissimilarity(v: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """A searchlight measure: the mean of 1 - r between the conditions' mean patterns."""
    means = np.stack([v[y == k].mean(axis=0) for k in np.unique(y)])
    if means.shape[1] < 2 or len(means) < 2:
        return 0.0
    with np.errstate(all="ignore"):
        r = np.corrcoef(means)
    return float(np.nanmean(1 - r[np.triu_indices(len(means), 1)])) if np.isfinite(r).any() else 0.0


def pattern_spread(v: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """A searchlight measure: the root mean square of the conditions' mean patterns."""
    return float(np.sqrt(np.mean(np.stack([v[y == k].mean(axis=0) for k in np.unique(y)]) ** 2)))


def linear_classifier(train: DataFrame, label: str, features: str, rounds: int = 50):
    """A linear support-vector machine of array features and 0/1 labels, trained by Spark; ``transform`` it on rows with a ``features`` vector."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    d = train.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    return LinearSVC(maxIter=rounds, regParam=0.01).fit(d)
