"""Ranked lexical search: term-at-a-time over index segments, with a limit on new accumulators.

One pass over the texts writes an index: a document's terms as 64-bit hashes
(two of a billion terms share one with a chance under 0.03) with their counts.
Statistics are sums over it.  Each task then holds one segment of documents at
a time as an inverted index, and ranks all items of a block against it:

* an item's terms come rarest first;
* a term's weight times its highest impact in the segment bounds what it can
  add.  Once the bounds of all terms to come lie under the k-th best partial
  score (of the segment's accumulators and of what the task has ranked before),
  a document without an accumulator can't be among the k best any more: no new
  ones are created;
* the accumulators that there are go on to be updated exactly.

A task returns its k best documents of an item, and these meet in one window.
The items are the given query set; they come in blocks of bounded size, the
documents are never filtered.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import dropped, written
from ._text import few_rows, hash_runs, mix

#: Documents of a segment.
SEGMENT = 32_768
#: Terms (item and term) of a block of items, which is broadcast; terms of an index that only keeps those of the items.
BLOCK_TERMS, VOCABULARY = 200_000, 1_000_000
#: Bytes of text that are taken apart at once.
PART_BYTES = 1 << 20

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_HASHED = np.where(_TERM, mix(np.arange(257, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), np.uint64(0))


def term_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term, and where in ``raw`` it begins."""
    a = _FOLD[np.frombuffer(raw, np.uint8)]
    inside = _TERM[a]
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    return hash_runs(a, start, _HASHED), start


def _parts(raws: list[bytes]):
    """(bytes, where texts begin in them, their numbers): about PART_BYTES of text each; longer texts are cut between terms."""
    some, at, who, size = [], [], [], 0
    for i, raw in enumerate(raws):
        begin = 0
        while begin < len(raw) or not raw and begin == 0:
            end = len(raw)
            if end - begin > PART_BYTES:
                room = np.frombuffer(raw, np.uint8, PART_BYTES, begin)
                gaps = np.flatnonzero(~_TERM[room])
                end = begin + int(gaps[-1]) + 1 if gaps.size else end  # a term longer than a part stays whole
            some.append(raw[begin:end])
            at.append(size)
            who.append(i)
            size += end - begin + 1
            begin = max(end, 1)
            if size >= PART_BYTES:
                yield b"\n".join(some) + b"\n", np.array(at), np.array(who)
                some, at, who, size = [], [], [], 0
    if some:
        yield b"\n".join(some) + b"\n", np.array(at), np.array(who)


def counted(texts: list, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n of each text, and text number, term and count of its distinct terms (of those in the sorted array ``only``), by text."""
    raws = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    n = np.zeros(len(raws), np.int64)
    found = []
    for buf, at, who in _parts(raws):
        h, start = term_hashes(buf)
        doc = who[np.searchsorted(at, start, "right") - 1]
        n += np.bincount(doc, minlength=n.size)
        if only is not None:
            k = np.minimum(np.searchsorted(only, h), max(only.size - 1, 0))
            ok = only[k] == h if only.size else np.zeros(h.size, bool)
            doc, h = doc[ok], h[ok]
        found.append(_sums(doc, h, np.ones(h.size, np.int64)))
    if len(found) > 1:
        found = [_sums(*(np.concatenate(x) for x in zip(*found, strict=True)))]
    return n, *(found[0] if found else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)))


def _sums(doc: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (doc, term) added up, by doc and term."""
    order = np.lexsort((h, doc))
    doc, h, c = doc[order], h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if doc.size else np.empty(0, np.int64)
    return doc[first], h[first], np.add.reduceat(c, first) if first.size else c


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, term and its occurrences in the item; rows of one item count together, a null item is one of its own."""
    kind = items.schema[item].dataType.simpleString()

    def run(batches):
        for b in few_rows(batches):
            _, who, h, c = counted(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array(h.view(np.int64)), pa.array(c)], ["item", "term", "c"])

    return items.select(item, text).mapInArrow(run, f"item {kind}, term long, c long").groupBy("item", "term").agg(F.sum("c").alias("c"))


def index(docs: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """doc_id, n (all terms with repeats) and, as arrays in bytes, the document's distinct terms and their counts; documents without a term are left out."""
    known = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        for b in few_rows(batches):
            n, who, h, c = counted(b.column(1).to_pylist(), known.value)
            ends = np.searchsorted(who, np.arange(n.size + 1))
            some = np.flatnonzero(n)
            cut = lambda a, i: a[ends[i] : ends[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(some)), pa.array(n[some]), pa.array([cut(h, i) for i in some], pa.binary()), pa.array([cut(c.astype(np.uint32), i) for i in some], pa.binary())], ["doc_id", "n", "terms", "counts"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def document_frequencies(indexed: DataFrame) -> DataFrame:
    """term and df, added up within tasks before the shuffle."""

    def run(batches):
        for b in batches:
            h, df = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(df.astype(np.int64))], ["term", "df"])

    return indexed.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Segment:
    """An inverted index of some documents over the terms ``vocabulary`` (sorted)."""

    def __init__(self, ids: pa.Array, n: np.ndarray, terms: list[bytes], counts: list[bytes], vocabulary: np.ndarray, n_docs: int, n_terms: int):
        self.unnamed = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        self.size = n.size
        h = np.frombuffer(b"".join(terms), np.uint64)
        tf = np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(n.size), [len(t) // 8 for t in terms])
        k = np.minimum(np.searchsorted(vocabulary, h), vocabulary.size - 1)
        ok = vocabulary[k] == h
        order = np.argsort(k[ok], kind="stable")
        k, self.doc, tf = k[ok][order], doc[ok][order], tf[ok][order]
        m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc])
        self.at = np.searchsorted(k, np.arange(vocabulary.size + 1))
        self.most = np.zeros(vocabulary.size, np.int64)
        np.maximum.at(self.most, k, self.impact)

    def rank(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """The item's documents into ``best``; ``terms`` (numbers in the vocabulary) come rarest first.  Returns the accumulators that were created."""
        score = np.zeros(self.size, np.int64)
        rest = np.concatenate([np.cumsum((weight * self.most[terms])[::-1])[::-1], [0]])
        survivors = None
        for j, (t, w) in enumerate(zip(terms.tolist(), weight.tolist(), strict=True)):
            if survivors is None and rest[j] <= max(best.highest, int(score.max(initial=0))) and rest[j] < best.kth(score):
                survivors = np.flatnonzero(score)
            doc, impact = self.doc[self.at[t] : self.at[t + 1]], self.impact[self.at[t] : self.at[t + 1]]
            if survivors is None:
                score[doc] += w * impact
            elif doc.size and survivors.size:
                at = np.minimum(np.searchsorted(doc, survivors), doc.size - 1)
                hit = doc[at] == survivors
                score[survivors[hit]] += w * impact[at[hit]]
        found = np.flatnonzero(score)
        best.add(score[found], self.ids[found], self.unnamed[found])
        return found.size if survivors is None else survivors.size


class Best:
    """The k best documents of an item: highest score first, equal ones by id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.unnamed = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def highest(self) -> int:
        return int(self.score[0]) if self.score.size else 0

    def kth(self, partial: np.ndarray) -> int:
        """The k-th best of partial scores and of those ranked before; 0 if there are fewer."""
        all_ = np.concatenate([self.score, partial])
        return int(np.partition(all_, all_.size - self.k)[all_.size - self.k]) if all_.size >= self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        score, ids, unnamed = np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), np.concatenate([self.unnamed, unnamed])
        if score.size > self.k:
            some = np.flatnonzero(score >= np.partition(score, score.size - self.k)[score.size - self.k])
            score, ids, unnamed = score[some], ids[some], unnamed[some]
        order = np.lexsort((ids, unnamed, -score))[: self.k]
        self.score, self.ids, self.unnamed = score[order], ids[order], unnamed[order]


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _segments(batches, size: int):
    """Arrow batches joined to tables of about ``size`` rows."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _ranked(indexed: DataFrame, own: pd.DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its number), doc_id and score: the k best of each task.  ``own``: number, term, c and df of a block's items."""
    own = own.assign(w=weights(own["df"].to_numpy(), n_docs)).query("w > 0").sort_values(["number", "df", "term"])
    vocabulary = np.unique(own["term"].to_numpy(np.int64).view(np.uint64))
    plan = [(number, np.searchsorted(vocabulary, g["term"].to_numpy(np.int64).view(np.uint64)), (g["w"] * g["c"]).to_numpy(np.int64)) for number, g in own.groupby("number")]
    shared = indexed.sparkSession.sparkContext.broadcast((vocabulary, plan))

    def run(batches):
        vocabulary, plan = shared.value
        best = {number: Best(k) for number, _, _ in plan}
        if plan:
            for t in _segments(batches, SEGMENT):
                s = Segment(t.column(0).combine_chunks(), t.column(1).to_numpy(), t.column(2).to_pylist(), t.column(3).to_pylist(), vocabulary, n_docs, n_terms)
                for number, terms, weight in plan:
                    s.rank(terms, weight, best[number])
        for number, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([number] * b.score.size, pa.int32()), pa.array(b.ids, pa.int64(), mask=b.unnamed), pa.array(b.score)], ["number", "doc_id", "score"])

    out = written(indexed.mapInArrow(run, "number int, doc_id long, score long"), "ranked")
    shared.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """item_id, rank, doc_id and score: each item's ``k`` best documents with a score above 0, equal scores by doc_id.

    A null text has no term and so no rank.  Every row of ``docs`` is a
    document: rows of one doc_id rank beside each other, those without one last
    among equals.  Extra columns are ignored; empty tables give no rows.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    terms = written(item_terms(items), "item-terms")
    distinct = terms.select("term").distinct()
    few = [r.term for r in distinct.limit(vocabulary + 1).collect()]
    only = np.unique(np.array(few, np.int64).view(np.uint64)) if len(few) <= vocabulary else None
    indexed = written(index(docs, only), "index")
    total = indexed.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    frequent = written(document_frequencies(indexed).join(distinct, "term", "left_semi"), "df")
    blocks = max(1, math.ceil(terms.count() / block_terms))
    numbered = terms.withColumn("_b", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for b in range(blocks if total.n else 0):
        own = numbered.where(F.col("_b") == b).join(frequent, "term").select("item", "term", "c", "df")
        rows = own.collect()
        place = {x: i for i, x in enumerate(dict.fromkeys(r.item for r in rows))}
        own = pd.DataFrame({"number": [place[r.item] for r in rows]} | {c: np.array([r[c] for r in rows], np.int64) for c in ("term", "c", "df")})
        names = docs.sparkSession.createDataFrame([(i, x) for x, i in place.items()], f"number int, item_id {kind}")
        part = _ranked(indexed, own, total.n, total.l, k).join(F.broadcast(names), "number").select("item_id", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    for t in (indexed, terms, frequent):
        dropped(t)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The ranking as DuckDB SQL over ``documents`` and ``benchmark``.
ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
q AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), r AS (
  SELECT item_id, doc_id, sum(c * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (doc_id) CROSS JOIN s GROUP BY ALL
), o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 10
"""
