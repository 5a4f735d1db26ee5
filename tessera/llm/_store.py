"""Intermediate tables, and joins with those that are small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import shared_dir, written

__all__ = ["dropped", "only", "shared_dir", "small_enough", "unused", "without", "written"]


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(name: str, df: DataFrame) -> str:
    """``name`` behind as many underscores as make it a name that no column of ``df`` begins with."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = f"_{name}"
    return name


#: Ids that may be broadcast: 8 bytes each, so at most about 16 MB as a hashed relation.
BROADCAST_IDS = 500_000


def small_enough(df: DataFrame, most: int = BROADCAST_IDS) -> bool:
    """Whether a written table has at most ``most`` rows, so that broadcasting it is bounded; the count reads no column."""
    return df.count() <= most


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in the written table ``ids``: without a shuffle of ``df`` while ``ids`` is small, by a shuffle join beyond that."""
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if small_enough(ids) else ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in the written table ``ids``; rows with a null key stay."""
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if small_enough(ids) else ids, key, "left_anti").select(df.columns)
