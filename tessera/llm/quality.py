"""Quality by importance resampling.

Two bag-of-n-gram generative models over ``BUCKETS`` hashed words and word
pairs are counted in Spark: the target model from the documents labelled good
(and not toxic, where labels say so), the raw model from all documents.  A
document's importance is the log of the ratio of its probabilities under the two
models, which is the sum over its n-grams, divided by ``temperature``; with
Gumbel noise added, the top ``share`` of all documents is a sample without
replacement in proportion to ``ratio ** (1 / temperature)``.  At temperature 1
these are the importance weights themselves.  They differ by many powers of ten
between texts of many words, so the noise decides among short texts and texts
near the cut; a higher temperature flattens the weights.  The share is that of
good documents among the labelled ones unless it is given.

The noise is a hash of the doc_id, so a rerun or a lost executor gives the same
sample.  The cut is exact: counts in ever finer bins narrow it down, and no
more than ``FEW`` keys come to the driver.

Defined results: null or word-free text has importance 0 under both models and
takes part; a null doc_id counts as -1 in the noise; a doc_id that any label row
calls good is target text once, however many rows or other labels it has; in
``good_share`` every label row counts; rows with equal keys at
the cut are all taken, so repeated rows stay together; without a good label the
importance is 0 everywhere and the sample is uniform; other columns are ignored
by ``score`` and ``sample``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import only, written
from ._text import Words, groups, ngrams

BUCKETS = 1 << 14
TEMPERATURE = 1.0
FEW = 10_000


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text of each."""
    w = Words(texts)
    two, off = ngrams(w.h, w.off, 2)
    n = np.arange(len(texts))
    doc = np.concatenate([np.repeat(n, np.diff(w.off)), np.repeat(n, np.diff(off))])
    return (np.concatenate([w.h, two]) >> np.uint64(50)).astype(np.int64), doc


def _counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    with np.errstate(over="ignore"):
        for b in batches:
            texts = b.column(0).to_pylist()
            for x, y in groups(texts):
                total += np.bincount(features(texts[x:y])[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of every bucket over all of ``docs``: at most BUCKETS rows come back."""
    got = docs.select(F.col("text").cast("string")).mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in got:
        out[r[0]] = r[1]
    return out


def good_labels(labels: DataFrame):
    """Whether a label row stands for target text; null where it has no quality."""
    good = F.col("quality") == 1
    return good & (F.coalesce(F.col("toxic"), F.lit(0)) != 1) if "toxic" in labels.columns else good


def good_share(labels: DataFrame) -> float:
    """The share of documents of quality 1 among the labelled ones; 0.5 without labels."""
    return labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.5


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of target to raw probability of each bucket, both smoothed by one raw-model count."""
    good = written(labels.where(good_labels(labels) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "good")
    raw = counts(docs)
    target = counts(only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), good, "doc_id"))
    if not target.sum():
        return np.zeros(BUCKETS)
    p = (raw + 1) / (raw.sum() + BUCKETS)
    q = (target + BUCKETS * p) / (target.sum() + BUCKETS)
    return np.log(q / p)


def score(docs: DataFrame, ratio: np.ndarray, seed: int = 3, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, importance and key (importance with Gumbel noise) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        r = shared.value
        with np.errstate(over="ignore"):
            for b in batches:
                texts = b.column(1).to_pylist()
                for x, y in groups(texts):
                    f, doc = features(texts[x:y])
                    s = np.bincount(doc, r[f], minlength=y - x)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(s / temperature)], names=["doc_id", "importance"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, importance double")
    u = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return d.withColumn("key", F.col("importance") - F.log(-F.log(u)))


def cut(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of the written column ``key``; None for k < 1."""
    if k < 1:
        return None
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        above = keys.where(F.col("key") > hi).count()
        if inside.count() <= FEW:
            few = sorted((r[0] for r in inside.select("key").collect()), reverse=True)
            return few[k - above - 1]
        edges = np.linspace(lo, hi, 1025)
        if edges[1] <= lo or lo == hi:
            return lo
        at = F.floor((F.col("key") - lo) / float(edges[1] - lo))
        rows = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(at.alias("at")).agg(F.count("*"), F.min("key"), F.max("key")).collect()}
        for i in sorted(rows, reverse=True):
            n, low, high = rows[i]
            if above + n >= k:
                if (low, high) == (lo, hi) or low == high:
                    return low
                lo, hi = low, high
                break
            above += n


def sample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 3, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, importance, key and selected of every row; the ``share`` of the rows with the largest keys is selected."""
    share = good_share(labels) if share is None else share
    keys = written(score(docs, fit(docs, labels), seed, temperature), "keys")
    at = cut(keys, math.ceil(share * keys.count()))
    return keys.withColumn("selected", F.lit(False) if at is None else F.col("key") >= at)
