"""Minimum spanning trees in Borůvka rounds, and single linkage cut from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written


def spanning_tree(edges: DataFrame, a: str, b: str, w: str) -> DataFrame:
    """The edges (a < b, and w) of the minimum spanning forest; equal weights are taken by a, then b.

    In a round every component takes its least edge to another one, and the
    chains of components that arise become one by doubling pointers.  The order
    of edges is total, so chains end in pairs that took the same edge.  Each
    round at least halves the components that have an edge out, so a graph of n nodes takes log n
    rounds; edges inside a component leave.  Loops and null weights are left out.
    """
    e = edges.where(F.col(w).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(w).alias("w"))
    e = e.groupBy("a", "b").agg(F.min("w").alias("w"))
    e = written(e.select("*", F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    tree = None
    while not e.isEmpty():
        key = F.struct("w", "a", "b")
        ends = e.select("u", key.alias("k"), F.col("v").alias("to")).unionByName(e.select(F.col("v").alias("u"), key.alias("k"), F.col("u").alias("to")))
        took = written(ends.groupBy("u").agg(F.min(F.struct("k", "to")).alias("m")).select("u", "m.k", "m.to"), "took")
        found = took.select("k.a", "k.b", "k.w").distinct()
        tree = written(found if tree is None else tree.unionByName(found), "tree")
        # of two that took the same edge the lesser is the end of the chain
        back = took.select(F.col("u").alias("to"), F.col("to").alias("_back"))
        p = took.join(back, "to", "left").select("u", F.when((F.col("_back") == F.col("u")) & (F.col("u") < F.col("to")), F.col("u")).otherwise(F.col("to")).alias("r"))
        p = written(p, "roots")
        while True:
            ahead = p.select(F.col("u").alias("r"), F.col("r").alias("_r"))
            q = written(p.join(ahead, "r").select("u", F.col("_r").alias("r"), (F.col("_r") != F.col("r")).alias("_moved")), "roots")
            p = q.select("u", "r")
            if q.where("_moved").isEmpty():
                break
        e = e.join(p, "u").withColumn("u", F.col("r")).drop("r").join(p.withColumnRenamed("u", "v"), "v").withColumn("v", F.col("r")).drop("r")
        e = written(e.where("u <> v").select("a", "b", "w", "u", "v"), "edges")
    return e.select("a", "b", "w") if tree is None else tree


def single_linkage(nodes: DataFrame, node: str, tree: DataFrame, heights: list[float]) -> DataFrame:
    """node, height and cluster (its least node): the clusters of a spanning tree cut at each height, all heights at once."""
    cut = F.explode(F.array(*[F.lit(float(h)) for h in heights])).alias("height")
    e = tree.select("*", cut).where("w <= height").select("height", "a", "b")
    e = written(e.unionByName(e.select("height", F.col("b").alias("a"), F.col("a").alias("b"))), "cut")
    to = written(nodes.select(F.col(node).alias("a")).distinct().select("a", F.col("a").alias("c"), cut), "clusters")
    while True:
        near = e.join(to.withColumnRenamed("a", "b"), ["height", "b"]).groupBy("height", "a").agg(F.min("c").alias("_c"))
        step = to.join(near, ["height", "a"], "left").select("height", "a", "c", F.coalesce(F.least("c", "_c"), F.col("c")).alias("n"))
        ahead = step.select("height", F.col("a").alias("n"), F.col("n").alias("_n"))
        new = written(step.join(ahead, ["height", "n"]).select("height", "a", F.col("_n").alias("c"), (F.col("_n") != F.col("c")).alias("_moved")), "clusters")
        to = new.select("height", "a", "c")
        if new.where("_moved").isEmpty():
            return to.select(F.col("a").alias(node), "height", F.col("c").alias("cluster"))
