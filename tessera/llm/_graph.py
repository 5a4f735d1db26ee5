"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b: long); component is the smallest id reachable.

    Large-star and small-star rounds: each replaces an edge by edges to the
    smallest neighbour, so a path of n ids is flat after about log n rounds.
    Edges stay linear in number; every round is one shuffle on the ids and is
    written to the shared folder.  A hub's edges are pre-aggregated (``min``)
    before the shuffle.  Nulls and loops are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    mark = _mark(e)
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every neighbour above u goes to the smallest of u and its neighbours
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        # small star: neighbours not above u, and u itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = written(small.where("u <> v").distinct(), "edges")
        mark, last = _mark(new), mark
        dropped(e)
        e = new
        if mark == last:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")


def _mark(e: DataFrame) -> tuple:
    """Equal for equal edge sets: the count and the sum of row hashes."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)
