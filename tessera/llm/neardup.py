"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of five-word shingles; two documents are linked when
``100 * |A & B| >= 75 * |A | B|``.  Equal sets are one class, so copies cost
nothing after the first step.  Classes are then branched in several
independent trees: a node's members pick tokens (their minwise value under a
function that the node chooses) and go to the child that the token names.
Small nodes are compared exhaustively.  A node that stays large is compared
with its pivot.  If that leaves more than one group in it, the members close to
the pivot are compared with all that resembles it, in blocks of bounded size
where they are many, and the others branch further; below the last level all
that is left of a large node is compared in blocks, so no member is dropped.
Every link is confirmed on the full sets.  With eight trees and two children a
level, a link at the threshold is met with probability over 0.9999.

Defined results: null or word-free text has an empty set and is linked with
nothing; texts of one to four words have their whole sequence as one shingle;
repeated rows of a doc_id count as one document; rows with a null doc_id are
left out of links and come back alone; other columns of the input are ignored
by ``components_of`` and passed through unchanged by ``deduplicate``; empty
tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import dropped, only, without, written
from ._text import Words, few_rows, groups, mix, shingle_sets

K = 128  # minwise functions
TREES = 8
CHILDREN = 2
LEVELS = 5
LEAF = 64  # members that are compared exhaustively
AGREE = 96  # of 128 one-bit sketches: over 4 standard deviations below what a link at 0.75 gives
CLOSE = 0.65  # estimated similarity to the pivot from which a member need not branch: what it is linked with is ALIKE, too
ALIKE = 0.15  # estimated similarity to the pivot of what a close member is compared with: CLOSE less 0.25 and the error of both estimates
FEW = 16  # close members whose candidates are found by a join; more are compared in blocks
BLOCK = 200_000  # shingles in a block
LIGHT = 100  # shingles that a member counts for at least, so that a block has few members, too

with np.errstate(over="ignore"):
    _A = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    _B = mix(np.arange(101, K + 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minhashes(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(sets, K) minwise values of non-empty sets that lie one after another in ``s``."""
    out = np.empty((off.size - 1, K), np.uint32)
    at = off[:-1]
    v = np.empty_like(s)
    for i in range(K):
        np.multiply(s, _A[i], out=v)
        v += _B[i]
        v >>= np.uint64(32)
        out[:, i] = np.minimum.reduceat(v, at)
    return out


def _runs(sets: list[np.ndarray], most: int = 1 << 15):
    """Sets in runs of about ``most`` elements, which stay in the processor's cache."""
    begin = size = 0
    for i, s in enumerate(sets):
        if i > begin and size + s.size > most:
            yield begin, i
            begin, size = i, 0
        size += s.size
    if begin < len(sets):
        yield begin, len(sets)


def _signatures(batches):
    """doc_id, n_shingles, digest of the set (2 x 64 bits), one-bit sketch, minwise values."""
    with np.errstate(over="ignore"):
        for batch in few_rows(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in groups(texts):
                sets = list(shingle_sets(Words(texts[a:b])))
                n = np.array([s.size for s in sets], np.int64)
                lo = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                hi = np.array([mix(s ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64) for s in sets], np.uint64)
                mh = np.zeros((len(sets), K), np.uint32)
                full = np.flatnonzero(n)
                some = [sets[i] for i in full]
                for x, y in _runs(some):
                    off = np.concatenate([[0], np.cumsum(n[full[x:y]])])
                    mh[full[x:y]] = minhashes(np.concatenate(some[x:y]), off)
                bits = np.packbits((mh & 1).astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array([m.tobytes() for m in mh], pa.binary())],
                    names=["doc_id", "n_shingles", "lo", "hi", "s0", "s1", "mh"],
                )


def _sets(batches):
    for batch in few_rows(batches):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in groups(texts):
            with np.errstate(over="ignore"):
                sets = [s.view(np.int64) for s in shingle_sets(Words(texts[a:b]))]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "sh"])


def _token(mh: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The minwise value of the coordinate that ``salt`` picks, as a child's 64-bit name."""
    i = (salt % np.uint64(K)).astype(np.int64)
    return mix(salt ^ mh[np.arange(len(i)), i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _roots(batches):
    """Every class goes to one child of the root in each tree."""
    with np.errstate(over="ignore"):
        for b in batches:
            mh = np.frombuffer(b"".join(b.column("mh").to_pylist()), np.uint32).reshape(-1, K)
            for t in range(TREES):
                salt = np.full(len(mh), K * 1009 + t, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_token(mh, salt)), *(b.column(c) for c in ("rep", "n", "s0", "s1"))], names=["node", "rep", "n", "s0", "s1"])


def _close(p: str, q: str):
    """Sizes and sketches allow a link."""
    small, large = F.least(f"{p}.n", f"{q}.n"), F.greatest(f"{p}.n", f"{q}.n")
    apart = F.bit_count(F.expr(f"{p}.s0 ^ {q}.s0")) + F.bit_count(F.expr(f"{p}.s1 ^ {q}.s1"))
    return (small * 100 >= large * 75) & (apart <= K - AGREE)


def _within(df: DataFrame, labels: bool) -> DataFrame:
    """Candidate pairs of small nodes; with ``labels``, of different labels only."""
    x, y = df.alias("x"), df.alias("y")
    on = (F.col("x.node") == F.col("y.node")) & (F.col("x.rep") < F.col("y.rep")) & _close("x", "y")
    if labels:
        on &= F.col("x.label") != F.col("y.label")
    return x.join(y, on).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _to_pivot(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidate pairs of large nodes' members with the node's pivot."""
    x, y = df.alias("x"), sizes.select("node", "pivot.*").alias("y")
    on = (F.col("x.node") == F.col("y.node")) & (F.col("x.rep") > F.col("y.rep")) & _close("x", "y")
    return x.join(y, on).select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b"))


def _sizes(df: DataFrame, *more) -> DataFrame:
    return df.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n", "s0", "s1")).alias("pivot"), *more).where("size > 1")


def _set_table(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and shingle set of the documents in the written table ``ids``, written."""
    texts = only(docs, ids, "doc_id").select("doc_id", "text")
    return written(texts.mapInArrow(_sets, "doc_id long, sh array<long>").dropDuplicates(["doc_id"]), "sets")


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    used = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "used")
    sets = _set_table(used, docs)
    a = sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("k", F.size(F.array_intersect("sa", "sb")))
    links = both.where((F.col("k") * 100) >= (F.size("sa") + F.size("sb") - F.col("k")) * 75).select("a", "b")
    links = written(links, "links")
    dropped(sets)
    return links


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)) sizes of the intersections of sorted sets."""
    vx, vy = np.concatenate(x), np.concatenate(y)
    words = np.intersect1d(vx, vy)
    out = np.zeros((len(x), len(y)), np.float32)

    def place(v, sets):
        row = np.repeat(np.arange(len(sets)), [s.size for s in sets])
        col = np.minimum(np.searchsorted(words, v), max(words.size - 1, 0))
        ok = words[col] == v if words.size else np.zeros(v.size, bool)
        return row[ok], col[ok]

    (rx, cx), (ry, cy) = place(vx, x), place(vy, y)
    for lo in range(0, words.size, 8192):  # products of 0/1 matrices, some columns at a time
        m = []
        for r, c, n in ((rx, cx, len(x)), (ry, cy, len(y))):
            own = (c >= lo) & (c < lo + 8192)
            a = np.zeros((n, min(8192, words.size - lo)), np.float32)
            a[r[own], c[own] - lo] = 1
            m.append(a)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _compare_blocks(pdf):
    """One pair of blocks of a cluster: the links between members of different labels."""
    import pandas as pd

    first, second = pdf[pdf.side == 0], pdf[pdf.side == 1]
    if not len(second):  # a block with itself
        second = first
    if not len(first):
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    x, y = [np.asarray(v, np.int64) for v in first.sh], [np.asarray(v, np.int64) for v in second.sh]
    k = shared_counts(x, y)
    n = np.array([v.size for v in x])[:, None] + np.array([v.size for v in y])[None, :]
    ri, rj = first.rep.to_numpy(), second.rep.to_numpy()
    ok = (100 * k >= 75 * (n - k)) & (first.label.to_numpy()[:, None] != second.label.to_numpy()[None, :])
    i, j = np.nonzero(ok)
    a, b = np.minimum(ri[i], rj[j]), np.maximum(ri[i], rj[j])
    return pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def _in_blocks(members: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links inside clusters (cluster, rep, n, label) between members of different labels.

    Members are dealt into blocks of about BLOCK shingles, and every pair of
    blocks of a cluster is one group of its own, so a group's size is bounded
    whatever the size of the cluster.
    """
    size = members.groupBy("cluster").agg(F.min(F.struct("rep", "label")).alias("first"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("cluster", F.col("first.label").alias("main"))
    m = members.join(size, "cluster").withColumn("own", F.col("label") == F.col("main"))
    weight = F.greatest("n", F.lit(LIGHT))
    blocks = m.groupBy("cluster").agg(F.ceil(F.sum(F.when(F.col("own"), weight)) / BLOCK).alias("na"), F.ceil(F.sum(F.when(~F.col("own"), weight)) / BLOCK).alias("nb"))
    m = written(m.join(blocks, "cluster"), "members")
    if m.isEmpty():
        return None
    used = written(m.select(F.col("rep").alias("doc_id")).distinct(), "used")
    sets = _set_table(used, docs)
    # blocks 0 .. na-1 hold the first member's label, which need not be compared within itself; the others follow
    h = F.xxhash64("rep", "cluster")
    m = m.withColumn("blk", F.when(F.col("own"), F.pmod(h, F.col("na"))).otherwise(F.col("na") + F.pmod(h, F.col("nb"))))
    m = m.withColumn("other", F.explode(F.sequence(F.when(F.col("own"), F.col("na")).otherwise(F.lit(0).cast("long")), F.col("na") + F.col("nb") - 1)))
    m = m.select("cluster", "rep", "label", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), (F.col("blk") > F.col("other")).cast("int").alias("side"))
    m = m.join(sets.select(F.col("doc_id").alias("rep"), "sh"), "rep")
    links = written(m.groupBy("cluster", "i", "j").applyInPandas(_compare_blocks, "a long, b long").distinct(), "links")
    dropped(sets)
    return links


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = written(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, lo long, hi long, s0 long, s1 long, mh binary"), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    # one class for each different set; min pre-aggregates, so a hot class is one row a task
    classes = some.groupBy("n_shingles", "lo", "hi").agg(F.min(F.struct("doc_id", "s0", "s1", "mh")).alias("r"))
    reps = written(classes.select(F.col("r.doc_id").alias("rep"), F.col("n_shingles").alias("n"), "r.s0", "r.s1", "r.mh", "lo", "hi"), "classes")

    nodes = written(reps.select("rep", "n", "s0", "s1", "mh").mapInArrow(_roots, "node long, rep long, n long, s0 long, s1 long"), "nodes")
    sizes = written(_sizes(nodes), "sizes")
    large = sizes.where(F.col("size") > LEAF)
    small = nodes.join(sizes.where(F.col("size") <= LEAF).select("node"), "node", "left_semi")
    pairs = written(_within(small, False).union(_to_pivot(nodes, large)).distinct(), "pairs")
    links = _linked(pairs, docs)
    found = components(links)

    mixed = nodes.join(large.select("node"), "node", "left_semi").join(found.select(F.col("id").alias("rep"), F.col("component").alias("label")), "rep", "left")
    mixed = mixed.select("node", "rep", "n", "s0", "s1", F.coalesce("label", "rep").alias("label")).join(reps.select("rep", "mh"), "rep")
    hot = written(mixed.select("node", "rep", "n", "s0", "s1", "label", "mh"), "nodes")
    dropped(nodes)
    more, clusters = _deeper(hot)
    new = []
    if more is not None:
        new.append(_linked(written(more.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs"), docs))
    if clusters is not None and (inside := _in_blocks(clusters.distinct(), docs)) is not None:
        new.append(inside)
    if new:
        for extra in new:
            links = links.union(extra)
        found = components(links)

    by_rep = reps.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "lo", "hi", F.coalesce("component", "rep").alias("component"))
    out = sig.join(by_rep.select(F.col("n").alias("n_shingles"), "lo", "hi", "component"), ["n_shingles", "lo", "hi"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _deeper(hot: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """From below the large nodes (node, rep, n, s0, s1, label, mh): candidate pairs (a, b), and clusters (cluster, rep, n, label) to compare in blocks.

    Links within a label are known already, so nodes of one label end.  In a
    large node, the members close to the pivot are compared with all that is
    alike, and the others branch: a child is named by the minwise value at a
    coordinate that the node and the child's number choose.
    """
    pairs = clusters = None

    def add(to, df):
        return df if to is None else to.union(df)

    for level in range(LEVELS):
        spread = F.min("label").alias("l0"), F.max("label").alias("l1")
        sizes = written(_sizes(hot, *spread).where("l0 <> l1"), "sizes")
        if sizes.isEmpty():
            break
        small = hot.join(sizes.where(F.col("size") <= LEAF).select("node"), "node", "left_semi")
        pairs = add(pairs, written(_within(small, True).distinct(), "pairs"))
        big = sizes.where(F.col("size") > LEAF).select("node", F.col("pivot.rep").alias("pivot"), F.col("pivot.s0").alias("p0"), F.col("pivot.s1").alias("p1"))
        apart = F.bit_count(F.expr("s0 ^ p0")) + F.bit_count(F.expr("s1 ^ p1"))
        rest = written(hot.join(big, "node").withColumn("est", 1 - 2 * apart / K).drop("p0", "p1"), "rest")
        dropped(hot)
        if level == LEVELS - 1:
            return pairs, add(clusters, rest.select(F.col("node").alias("cluster"), "rep", "n", "label"))
        close = rest.where(F.col("est") >= CLOSE)
        many = written(close.groupBy("node").agg(F.count("*").alias("n_close")).where(F.col("n_close") > FEW).select("node"), "many")
        x, y = close.join(many, "node", "left_anti").alias("x"), rest.alias("y")
        on = (F.col("x.node") == F.col("y.node")) & (F.col("x.rep") != F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & _close("x", "y")
        pairs = add(pairs, written(x.join(y, on).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), "pairs"))
        alike = rest.where(F.col("est") >= ALIKE).join(many, "node", "left_semi")
        clusters = add(clusters, written(alike.select(F.col("pivot").alias("cluster"), "rep", "n", "label").distinct(), "clusters"))
        far = rest.where(F.col("est") < CLOSE).withColumn("child", F.explode(F.array(*[F.lit(c) for c in range(CHILDREN)])))
        at = F.pmod(F.xxhash64("node", "child"), F.lit(K)).cast("int") * 4 + 1
        token = F.xxhash64("node", "child", F.substr("mh", at, F.lit(4)))
        hot = written(far.select(token.alias("node"), "rep", "n", "s0", "s1", "label", "mh"), "nodes")
    return pairs, clusters


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the smallest doc_id of their group; repeated rows of a kept doc_id stay."""
    gone = written(components_of(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return without(docs, gone, "doc_id")
