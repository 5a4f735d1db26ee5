"""Benchmark passages in documents, by SimHash over item-sized windows.

Items are put into classes by length; a class hashes windows of one length,
which is between 0.73 and 0.88 of its items' (less below ten words), at the first ``stride`` offsets of an
item, and of a document at every stride-th offset, so that one window of every
embedded item is the same as one of the item's.  A changed word of thirty moves about five bits of a window.
The 64-bit fingerprints of the items are indexed in four 16-bit blocks with all
neighbours of one and two bits: every pair within ``RADIUS`` = 11 bits shares an
entry, since one of its blocks differs in two bits at most.  Each pair within the
radius gives an alignment, and the aligned passage is verified by the weighted
Jaccard similarity (multiset counts) of five-word shingles, 0.75 or more.

Defined results: words are compared in lower case; null or word-free
texts and items match nothing; an item of fewer than five words is one shingle;
repeated items and documents give the same row once per (doc_id, item_id);
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import without, written
from ._text import Words, few_rows, groups, mix, ngrams

RADIUS = 11
SIMILARITY = 0.75
SHINGLE = 5
#: Items that are held in memory at once; a larger benchmark is searched in blocks of so many, one scan of the documents each.
ITEM_BLOCK = 5_000
#: The most words between two windows of a document.
STRIDE = 16
#: Words whose bit counts are summed at once.
SPAN = 1 << 11


#: The bits in which a block of 16 can differ by two at most.
_NEAR = np.array([0, *(1 << i for i in range(16)), *(1 << i | 1 << j for i, j in combinations(range(16), 2))], np.int64)


def _grid(n: int) -> int:
    """The window length for an item of n words: the largest of 5, 6, 7 ..., a fifth longer each time, that is at most 0.88 n; n itself up to five words."""
    w = min(n, 5)
    while n > 5 and (up := max(w + 1, w * 6 // 5)) <= 0.88 * n:
        w = up
    return w


def _windows(h: np.ndarray, wanted: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """For each (starts, w): the SimHash of h[s : s + w] for every start s, sorted.  One pass sums the bits for all lengths."""
    out = [np.empty(start.size, np.uint64) for start, _ in wanted]
    over = max((w for _, w in wanted), default=0)
    kind = np.uint16 if over < 1 << 16 else np.uint32
    for lo in range(0, h.size, SPAN):
        hi = min(h.size, lo + SPAN + over)
        total = np.zeros((hi - lo + 1, 64), kind)
        np.cumsum(np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=kind, out=total[1:])
        for (start, w), o in zip(wanted, out, strict=True):
            i, j = np.searchsorted(start, (lo, lo + SPAN))
            if i < j:
                at = start[i:j] - lo
                n = total[at + w]
                n -= total[at]
                o[i:j] = np.packbits(n > w // 2, axis=1).view(np.uint64)[:, 0]
    return out


class Index:
    """The fingerprints of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.n, self.grams, self.classes = [], [], [], {}
        by_class: dict[int, list] = {}
        all_words: list[np.ndarray] = [np.empty(0, np.uint64)]
        for item, text in items:
            h = Words([text.lower()], lower=False).h
            if not h.size:
                continue
            w, k = _grid(h.size), len(self.ids)
            self.ids.append(item)
            self.n.append(h.size)
            all_words.append(h)
            self.grams.append(_shingles(h))
            by_class.setdefault(w, []).append((k, h))
        self.lengths = np.array(self.n, np.int64)
        self.salt = mix(np.arange(1, self.lengths.size + 1, dtype=np.uint64))
        slots = np.concatenate(all_words) ^ np.repeat(self.salt, self.lengths)
        self.shift = np.uint64(64 - max(10, (16 * slots.size).bit_length()))
        self.has = np.zeros(1 << (64 - int(self.shift)), bool)  # the words of each item; a chance hit makes a bound too high, never too low
        self.has[slots >> self.shift] = True
        for w, found in by_class.items():
            stride = min(STRIDE, min(h.size for _, h in found) - w + 1)
            offset = np.tile(np.arange(stride), len(found))  # so many meet one in stride of a document's windows
            item = np.repeat([k for k, _ in found], stride)
            fp = np.concatenate([_windows(h, [(np.arange(stride), w)])[0] for _, h in found])
            tables = []
            for b in range(4):
                block = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                near = (block[None] ^ _NEAR[:, None]).ravel()
                who = np.tile(np.arange(fp.size), _NEAR.size)
                order = np.argsort(near, kind="stable")
                tables.append((np.searchsorted(near[order], np.arange(65537)).astype(np.int32), who[order].astype(np.int32)))
            self.classes[w] = (stride, item, offset, fp, tables)

    def near(self, fp: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, entry) within the radius."""
        _, _, _, mine, tables = self.classes[w]
        got_w, got_e = [], []
        for b, (first, who) in enumerate(tables):
            block = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int32)
            lo = first[block]
            count = first[block + 1] - lo
            win = np.flatnonzero(count)
            c = count[win]
            if not win.size:
                continue
            at = np.repeat(lo[win] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
            win, entry = np.repeat(win, c), who[at]
            ok = np.bitwise_count(fp[win] ^ mine[entry]) <= RADIUS
            got_w.append(win[ok])
            got_e.append(entry[ok])
        if not got_w:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(got_w), np.concatenate(got_e)


def _shingles(h: np.ndarray) -> Counter:
    k = min(SHINGLE, h.size)
    return Counter(ngrams(h, np.array([0, h.size]), k)[0].tolist())


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: the sum of the smaller counts over the sum of the larger."""
    low = sum((a & b).values())
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def _aligned(off, h, win, entry, text, begin, item, index):
    """Those pairs within the radius, once for each alignment, whose passage has enough words of the item.  Every shared shingle begins with a shared word, so the words in common bound the shared shingles, and no passage of similarity 0.75 goes."""
    _, once = np.unique(np.stack([begin, item]), axis=1, return_index=True) if win.size else (None, np.empty(0, np.int64))
    win, entry, text, begin, item = win[once], entry[once], text[once], begin[once], item[once]
    n = index.lengths[item]
    begin = np.maximum(begin, off[text])
    m = np.minimum(begin + n, off[text + 1]) - begin
    row = np.repeat(np.arange(win.size), m)
    at = np.repeat(begin - np.cumsum(m) + m, m) + np.arange(row.size)
    common = np.bincount(row, index.has[(h[at] ^ index.salt[item[row]]) >> index.shift], minlength=win.size)
    k = np.minimum(SHINGLE, n)
    ok = (m >= k) & (common >= SIMILARITY / (1 + SIMILARITY) * (n + m - 2 * k + 2) - 1e-9)
    return zip(win[ok].tolist(), entry[ok].tolist(), text[ok].tolist(), item[ok].tolist(), strict=True)


def _starts(off: np.ndarray, w: int, stride: int) -> np.ndarray:
    """Window starts of every text with w words or more: each ``stride`` words and the last place."""
    n = np.diff(off)
    long = np.flatnonzero(n >= w)
    count = (n[long] - w) // stride + 1
    at = np.repeat(off[:-1][long] - stride * np.concatenate([[0], np.cumsum(count)[:-1]]), count) + stride * np.arange(int(count.sum()))
    return np.unique(np.concatenate([at, off[1:][long] - w]))


def search(texts: list, index: Index) -> list[tuple]:
    """(text number, item_id, first word, words, similarity, bits apart) of the best passage of each item in each text."""
    best: dict[tuple, tuple] = {}
    with np.errstate(over="ignore"):
        for x, y in groups(texts):
            words = Words([t.lower() if t else None for t in texts[x:y]], lower=False)
            off = words.off
            seen = set()
            wanted = [(_starts(off, w, c[0]), w) for w, c in index.classes.items()]
            for (start, w), mine in zip(wanted, _windows(words.h, wanted), strict=True):
                _, item, offset, fp, _ = index.classes[w]
                win, entry = index.near(mine, w)
                text = np.searchsorted(off, start[win], "right") - 1
                for i, e, d, k in _aligned(off, words.h, win, entry, text, start[win] - offset[entry], item[entry], index):
                    begin = max(int(start[i]) - int(offset[e]), int(off[d]))
                    end = min(begin + index.n[k], int(off[d + 1]))
                    if (d, k, begin) in seen:
                        continue
                    seen.add((d, k, begin))
                    s = similarity(index.grams[k], _shingles(words.h[begin:end])) if end - begin >= min(SHINGLE, index.n[k]) else 0.0
                    if s >= SIMILARITY:
                        bits = int(np.bitwise_count(mine[i] ^ fp[e]))
                        row = (s, -begin, x + d, index.ids[k], begin - int(off[d]), end - begin, s, bits)
                        best[x + d, index.ids[k]] = max(best.get((x + d, index.ids[k]), row), row)
    return [v[2:] for _, v in sorted(best.items())]


def _finder(index):
    def find_in(batches):
        idx = index.value
        for batch in few_rows(batches):
            rows = search(batch.column(1).to_pylist(), idx)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.int32())],
                names=["doc_id", "item_id", "start_word", "n_words", "similarity", "bits_apart"],
            )

    return find_in


def _blocks(bench: DataFrame):
    block = []
    for r in bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null").distinct().toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block


def find(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, bits_apart: one row for each document and item whose passage it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start_word int, n_words int, similarity double, bits_apart int"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    with np.errstate(over="ignore"):
        for block in _blocks(bench):
            part = d.mapInArrow(_finder(spark.sparkContext.broadcast(Index(block))), schema)
            out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("similarity", "start_word", "n_words", "bits_apart")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.start_word", "b.n_words", "b.similarity", "b.bits_apart")


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark."""
    hits = written(find(docs, bench).where("doc_id is not null").select("doc_id").distinct(), "leaks")
    return without(docs, hits, "doc_id")
