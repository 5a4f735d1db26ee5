"""Feature vectors: distances, dissimilarity matrices, classifiers and k-means."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    z = F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(z, F.lit(0.0), lambda s, v: s + v)


def euclidean(a: str, b: str) -> Column:
    z = F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, v: s + v))


#: Queries that a task holds at once, and rows of a part that meets them.
BLOCK = 4_096
#: Pairs whose sums are built at once (they stay in a core's cache), pairs that leave in one batch, and pairs worth a task of their own.
TILE, OUT, TASK = 1 << 15, 1 << 17, 1 << 18


def _sizes(v: pa.Array) -> np.ndarray:
    """The length of each vector; -1 if it is null or holds one."""
    n = np.asarray(v.value_lengths().fill_null(-1)).astype(np.int64)
    if v.values.null_count:
        off = np.asarray(v.offsets).astype(np.int64)
        nulls = np.concatenate([[0], np.cumsum(np.asarray(v.values.is_null()))])
        n[(n >= 0) & (nulls[off[1:]] > nulls[off[:-1]])] = -1
    return n


def _by_position(v: pa.Array, at: np.ndarray, n: int) -> np.ndarray:
    """(n, vectors): the vectors at these places, each of n values, turned."""
    return np.asarray(v.take(pa.array(at)).flatten()).astype(float).reshape(at.size, n).T.copy()


def _tile(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(x, y) distances of vectors by position, summed in the order of the positions whatever the tile."""
    total, d = np.zeros((x.shape[1], y.shape[1])), np.empty((x.shape[1], y.shape[1]))
    for a, b in zip(x, y, strict=True):
        np.subtract(a[:, None], b, out=d)
        np.multiply(d, d, out=d)
        total += d
    return np.sqrt(total, out=total)


def _pair_distances(batches):
    """Rows by group, queries (side 0) before rows: every row with every query of its group.  Only a group's queries are held."""
    group, held = None, []
    for b in batches:
        of, side = (np.asarray(b.column(i)) for i in (0, 1))
        begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (side[1:] != side[:-1]))[: of.size])
        for lo, hi in zip(begin, [*begin[1:], of.size], strict=True):
            if of[lo] != group:
                group, held, ready = of[lo], [], None
            part = b.slice(lo, hi - lo)
            if side[lo] == 0:
                held.append(part)
            elif held:
                if ready is None:
                    q = pa.Table.from_batches(held).combine_chunks()
                    ids, v = (q.column(i).chunk(0) for i in (2, 4))
                    size = _sizes(v)
                    ready = ids, size, {int(n): (at := np.flatnonzero(size == n), _by_position(v, at, n)) for n in np.unique(size[size >= 0])}
                yield from _against(part.column(3), part.column(4), *ready)


def _against(keys: pa.Array, v: pa.Array, ids: pa.Array, own: np.ndarray, queries: dict):
    """query, key, distance of some rows and all queries of a group, a few rows at a time; null where lengths differ or a value is null."""
    size = _sizes(v)
    few = max(1, OUT // len(ids))
    for x in range(0, len(v), few):
        rows = size[x : x + few]
        out, known = np.zeros((rows.size, len(ids))), rows[:, None] == own
        known &= own >= 0
        for n, (at, y) in queries.items():
            mine = np.flatnonzero(rows == n)
            turned = _by_position(v, mine + x, n)
            whole = at.size == len(ids) and mine.size == rows.size
            strip = max(1, TILE // at.size)
            for i in range(0, mine.size, strip):
                d = _tile(turned[:, i : i + strip], y)
                if whole:
                    out[i : i + strip] = d
                else:
                    out[np.ix_(mine[i : i + strip], at)] = d
        missing = None if known.all() else ~known.ravel()
        of = np.arange(rows.size).repeat(len(ids))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.tile(np.arange(len(ids)), rows.size))), keys.slice(x, few).take(pa.array(of)), pa.array(out.ravel(), mask=missing)], names=["query", "key", "distance"])


def distances_to(df: DataFrame, key: str, vec: str, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """query, key, distance from a stated query set to every row.

    The pairs are the queries times the rows, so what bounds a task is its group: a
    block of about ``block`` queries, which it holds, and a part of the rows, which
    stream past them.  Groups are at least as many as all cores need, however few
    the files, and meet by a shuffle; nothing is broadcast.
    """
    sc = df.sparkSession.sparkContext
    kinds = {d.schema[vec].dataType.simpleString() for d in (df, queries)}
    values = F.col(vec) if kinds == {"array<float>"} else F.col(vec).cast("array<double>")
    n, m = queries.count(), df.count()
    blocks = max(1, -(-n // block))
    parts = max(1, -(-m // BLOCK), min(-(-4 * sc.defaultParallelism // blocks), -(-n * m // (TASK * blocks))))
    dealt = lambda count: F.pmod(F.xxhash64(key), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    id_type, key_type = queries.schema[key].dataType, df.schema[key].dataType
    q = queries.select(dealt(blocks).alias("_i"), every(parts).alias("_j"), F.lit(0).alias("_side"), F.col(key).alias("_query"), F.lit(None).cast(key_type).alias("_key"), values.alias("_v"))
    r = df.select(every(blocks).alias("_i"), dealt(parts).alias("_j"), F.lit(1).alias("_side"), F.lit(None).cast(id_type).alias("_query"), F.col(key).alias("_key"), values.alias("_v"))
    both = q.union(r).select((F.col("_i") * parts + F.col("_j")).alias("_group"), "_side", "_query", "_key", "_v")
    both = both.repartition(max(1, blocks * parts), "_group").sortWithinPartitions("_group", "_side")
    return both.mapInArrow(_pair_distances, f"query {id_type.simpleString()}, `{key}` {key_type.simpleString()}, distance double")


def _few_distances(df: DataFrame, key: str, vec: str, queries: DataFrame, block: int) -> DataFrame:
    """``distances_to`` for few queries, such as means: the rows are not shuffled, the queries are broadcast in blocks."""
    q = queries.select(F.col(key).alias("query"), F.col(vec).alias("_q"))
    blocks = max(1, -(-q.count() // block))
    out = None
    for i in range(blocks):
        some = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) if blocks > 1 else q
        part = df.crossJoin(F.broadcast(some)).select("query", key, euclidean(vec, "_q").alias("distance"))
        out = part if out is None else out.union(part)
    return out


def class_means(df: DataFrame, label: str, vec: str) -> DataFrame:
    """label and the mean vector of its rows, from sums per position."""
    e = df.select(label, F.posexplode(vec).alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return e.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(label, F.col("s.m").alias("mean"))


def class_dissimilarity(df: DataFrame, label: str, vec: str) -> DataFrame:
    """a, b and 1 - r of the mean vectors of every two classes; there are as many rows as pairs of classes."""
    m = class_means(df, label, vec)
    a, b = m.select(F.col(label).alias("a"), F.posexplode("mean").alias("i", "x")), m.select(F.col(label).alias("b"), F.posexplode("mean").alias("i", "y"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg((1 - F.corr("x", "y")).alias("dissimilarity"))


def nearest_mean(df: DataFrame, key: str, vec: str, means: DataFrame, label: str, block: int = BLOCK) -> DataFrame:
    """key and the class of the nearest mean vector; the classes are counted and broadcast in blocks, and a row meets its nearest of each block only."""
    d = _few_distances(df.select(F.col(key).alias("_key"), F.col(vec).alias("_vec")), "_key", "_vec", means.select(F.col(label).alias("_key"), F.col("mean").alias("_vec")), block)
    return d.groupBy("_key").agg(F.min(F.struct("distance", "query")).alias("m")).select(F.col("_key").alias(key), F.col("m.query").alias("predicted"))


def naive_bayes(df: DataFrame, key: str, label: str, vec: str, fold: Column) -> DataFrame:
    """key, label, predicted by Gaussian naive Bayes fitted on the rows that are not in ``fold``, for those that are."""
    d = df.withColumn("_test", fold)
    s = d.where(~F.col("_test")).select(label, F.posexplode(vec).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s2"), F.count("*").alias("n"))
    t = d.where("_test").select(key, F.col(label).alias("_true"), F.posexplode(vec).alias("i", "v"))
    ll = t.join(F.broadcast(s), "i").groupBy(key, "_true", label).agg(F.sum(-0.5 * F.log(F.col("s2") + 1e-9) - (F.col("v") - F.col("m")) * (F.col("v") - F.col("m")) / (2 * (F.col("s2") + 1e-9))).alias("ll"), F.max("n").alias("n"))
    best = ll.groupBy(key, "_true").agg(F.max_by(label, F.struct(F.col("ll") + F.log("n"), F.col(label))).alias("predicted"))
    return best.select(key, F.col("_true").alias(label), "predicted")


def k_means(df: DataFrame, key: str, vec: str, k: int, rounds: int = 10) -> DataFrame:
    """key, cluster and distance: Lloyd rounds from the k rows of the smallest keys' hash; centres are k rows, assignment is one pass without a shuffle of the vectors."""
    first = df.select(vec).orderBy(F.xxhash64(key), key).limit(k).collect()
    centres = np.array([r[0] for r in first], float)
    width = centres.shape[1] if len(centres) else 0

    def assign(v: np.ndarray, c: np.ndarray):
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), np.sqrt(d.min(axis=1))

    for _ in range(rounds):
        own = centres

        def sums(it, own=own):
            total, n = np.zeros((len(own), width)), np.zeros(len(own), np.int64)
            for pdf in it:
                v = np.array(pdf[vec].tolist(), float).reshape(len(pdf), -1)
                if len(v):
                    at = assign(v, own)[0]
                    np.add.at(total, at, v)
                    n += np.bincount(at, minlength=len(own))
            yield pd.DataFrame({"c": np.arange(len(own), dtype=np.int32), "n": n, "s": list(total)})

        got = df.select(vec).mapInPandas(sums, "c int, n long, s array<double>")
        rows = got.select("c", "n", F.posexplode("s").alias("i", "v")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
        new = centres.copy()
        for r in rows:
            if r.n:
                new[r.c, r.i] = r.v / r.n
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new

    def label(it, own=centres):
        for pdf in it:
            v = np.array(pdf[vec].tolist(), float).reshape(len(pdf), -1)
            at, d = assign(v, own) if len(v) else (np.empty(0, int), np.empty(0))
            yield pd.DataFrame({key: pdf[key], "cluster": at.astype(np.int32), "distance": d})

    return df.select(key, vec).mapInPandas(label, f"`{key}` {df.schema[key].dataType.simpleString()}, cluster int, distance double")
