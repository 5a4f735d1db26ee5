"""Substring dedup: word sequences of 50 or more that stand in an earlier document go.

Suffix automata of reference shards give matching statistics: the length of the
longest match that ends at each word.  Every window of 50 words that an
automaton of earlier documents holds is a match of that length, and overlapping
windows make maximal spans.  To stream all documents past all shards would be
quadratic in the corpus, so both sides are first cut down to what can match,
which loses nothing:

* Every window has an anchor: its least 20-word hash (leftmost, if equal).
  Equal windows have equal anchors, so only anchors of two documents matter,
  and only their contexts: all windows round an anchor, 80 words at most.
* Equal contexts are one row, that of their first document.  In any later
  document the whole context goes.
* Anchors with several contexts are dealt to shards of bounded size.  A shard's
  contexts come by document: each is streamed through the automaton of the
  earlier ones, and what it has of new windows extends the automaton.  Shard and
  contexts meet in one task instead of by broadcast, since the shards grow with
  the corpus; a broadcast of each would send all of them everywhere.
* An anchor with more than CROWD contexts (a common passage between ever other
  words) would make a shard of unbounded size.  Its contexts are taken as texts
  in turn, with longer anchors: the words beside the passage then stand alone
  and fall away, and what is left has few contexts.  The last anchors are whole
  windows, which have one context each.

Spans go back to the texts by a join on the document, broadcast only while
their counted number is small.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, written
from ._text import Words, few_rows, groups, mix, ngrams

#: Words of a window that goes if it repeats, and of the anchors, which get longer where they have too many contexts.
WINDOW, ANCHORS = 50, (20, 35, 45, 50)
#: Words of a shard; contexts of an anchor beyond which it gets longer.
SHARD_WORDS, CROWD = 150_000, 1_000
#: Spans or requests that may be broadcast, 24 bytes each.
BROADCAST_SPANS = 1_000_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

_BASE = 0x9FB21C651E98DF25


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        ones = np.full(n + 1, np.uint64(1))
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def run_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words lo:hi for every pair, from sums of the words' hashes times powers."""
    if not lo.size:
        return np.empty(0, np.uint64)
    up, down = _powers(h.size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: h.size], dtype=np.uint64)])
        return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def anchors(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' windows: text number, anchor (of ``size`` words), hash of the context, first word and length of the context."""
    n = np.diff(w.off)
    g, off = ngrams(w.h, w.off, size)
    wide = WINDOW - size + 1
    none = np.empty(0, np.int64)
    if g.size < wide:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    text = np.repeat(np.arange(n.size), np.diff(off))
    whole = text[: g.size - wide + 1] == text[wide - 1 :]  # windows inside one text
    least = np.lib.stride_tricks.sliding_window_view(g, wide).argmin(axis=1) + np.arange(g.size - wide + 1)
    at = np.unique(least[whole])
    doc = text[at]
    p = at - off[doc]  # the anchor's first word in its text
    lo, hi = np.maximum(p + size - WINDOW, 0), np.minimum(p + WINDOW, n[doc])
    return doc, g[at], run_hashes(w.h, w.off[doc] + lo, w.off[doc] + hi), lo, hi - lo


class Automaton:
    """A suffix automaton of word sequences, extended as they come."""

    def __init__(self):
        self.go: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, go: dict, link: int) -> int:
        self.length.append(length)
        self.go.append(go)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A copy of ``q`` for the shorter sequences that end in it by ``p`` and ``c``."""
        new = self._state(self.length[p] + 1, self.go[q].copy(), self.link[q])
        self.link[q] = new
        while p != -1 and self.go[p].get(c) == q:
            self.go[p][c] = new
            p = self.link[p]
        return new

    def add(self, words: list) -> None:
        go, link, length = self.go, self.link, self.length
        last = 0
        for c in words:
            q = go[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new = self._state(length[last] + 1, {}, 0)
            p = last
            while p != -1 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p != -1:
                q = go[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def matches(self, words: list) -> list[int]:
        """The matching statistics: the length of the longest match that ends at each word."""
        go, link, length = self.go, self.link, self.length
        state = matched = 0
        found = []
        for c in words:
            to = go[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = go[state].get(c)
            if to is None:
                matched = 0
            else:
                state = to
                matched += 1
            found.append(matched)
        return found


def spans(matched: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans of words in windows that end where ``window`` words or more match."""
    out: list[tuple[int, int]] = []
    for end, m in enumerate(matched, 1):
        if m >= window:
            if out and out[-1][1] >= end - window:
                out[-1] = (out[-1][0], end)
            else:
                out.append((end - window, end))
    return out


def stream(contexts: list[tuple[int, list]]) -> list[list[tuple[int, int]]]:
    """Spans of each (document, words), ordered by document, that an earlier document has."""
    held, found = Automaton(), []
    for _, own in groupby(contexts, key=lambda x: x[0]):
        own = [words for _, words in own]
        for words in own:
            matched = held.matches(words)
            found.append((words, matched, spans(matched)))
        for words, matched, _ in found[-len(own) :]:
            new = [e for e in range(WINDOW, len(words) + 1) if matched[e - 1] < WINDOW]
            if new:
                held.add(words[new[0] - WINDOW : new[-1]])
    return [f[2] for f in found]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and v, which tells texts under one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("v"))


def _anchored(texts: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for b in few_rows(batches):
            texts = b.column(1).to_pylist()
            for begin, end in groups(texts):
                doc, anchor, context, lo, n = anchors(Words(texts[begin:end], lower=False), size)
                of = pa.array(doc + begin)
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(2).take(of), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "v", "anchor", "context", "lo", "n"])

    return texts.where("doc_id is not null").mapInArrow(run, "doc_id long, v long, anchor long, context long, lo int, n int")


def _with_lists(texts: DataFrame, lists: DataFrame, total: int, most: int, how: str) -> DataFrame:
    """The texts beside their lists; ``total`` is the number of entries in all."""
    return texts.join(F.broadcast(lists) if total <= most else lists, ["doc_id", "v"], how)


def _words_of(texts: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """doc_id, anchor, context and words (joined by one space) of contexts."""
    lists = written(wanted.groupBy("doc_id", "v").agg(F.collect_list(F.struct("lo", "n", "anchor", "context")).alias("wanted")), "wanted")

    def run(batches):
        for b in few_rows(batches, 64):
            out: dict[str, list] = {"doc_id": [], "anchor": [], "context": [], "words": []}
            for doc, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = text.encode().split()
                for x in wanted:
                    for k, y in zip(out, (doc, x["anchor"], x["context"], b" ".join(words[x["lo"] : x["lo"] + x["n"]]).decode()), strict=True):
                        out[k].append(y)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("words", pa.string())]))

    return _with_lists(texts, lists, wanted.count(), most, "inner").select("doc_id", "text", "wanted").mapInArrow(run, "doc_id long, anchor long, context long, words string")


def _by_automata(contexts: DataFrame, shards: int) -> DataFrame:
    """anchor, context, from, to: the spans of contexts that earlier documents have."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        doc, anchor, context, words = (table.column(c).to_pylist() for c in ("doc_id", "anchor", "context", "words"))
        number: dict[str, int] = {}
        found = stream([(d, [number.setdefault(x, len(number)) for x in w.split(" ")]) for d, w in zip(doc, words, strict=True)])
        rows = [(a, c, *s) for a, c, own in zip(anchor, context, found, strict=True) for s in own]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.table([pa.array(columns[i], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["anchor", "context", "from", "to"])

    return contexts.groupBy(F.pmod("anchor", F.lit(shards)).alias("shard")).applyInArrow(run, "anchor long, context long, from int, to int")


def repeated(docs: DataFrame, broadcast: int = BROADCAST_SPANS, shard_words: int = SHARD_WORDS, crowd: int = CROWD) -> tuple[DataFrame, int]:
    """A written table of doc_id, v and spans (word numbers, end exclusive; apart and in order) that stand in a document with a smaller id, and their number."""
    found = _repeated(_texts(docs), ANCHORS, broadcast, shard_words, crowd)
    return found, found.agg(F.sum(F.size("spans"))).first()[0] or 0


def _repeated(texts: DataFrame, sizes: tuple, broadcast: int, shard_words: int, crowd: int) -> DataFrame:
    """doc_id, v and spans of texts (doc_id, text and v), by anchors of the first of ``sizes``; a written table."""
    every = written(_anchored(texts, sizes[0]), "anchors")
    shared = written(every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor"), "shared")
    met = written(every.join(shared, "anchor", "left_semi"), "met")
    for t in (every, shared):
        dropped(t)
    # one row a context: where its first document has it
    place = F.min(F.struct("doc_id", "v", "lo", "n"))
    contexts = written(met.groupBy("anchor", "context").agg(place.alias("p")).select("anchor", "context", "p.*"), "contexts")
    several = written(contexts.groupBy("anchor").agg(F.count("*").alias("k"), F.sum("n").alias("words")).where("k > 1"), "several")
    words = several.where(F.col("k") <= crowd).agg(F.sum("words")).first()[0] or 0
    wanted = contexts.join(several.select("anchor", "k"), "anchor")
    seen = _by_automata(_words_of(texts, wanted.where(F.col("k") <= crowd), broadcast), max(1, -(-words // shard_words)))
    used = [met, contexts, several]
    if len(sizes) > 1 and not several.where(F.col("k") > crowd).isEmpty():
        long = _words_of(texts, wanted.where(F.col("k") > crowd), broadcast).withColumnRenamed("words", "text")
        long = written(long.withColumn("v", F.xxhash64("anchor", "context")), "crowded")
        inner = _repeated(long.select("doc_id", "text", "v"), sizes[1:], broadcast, shard_words, crowd)
        inner = inner.select("doc_id", "v", F.inline("spans")).join(long.select("doc_id", "v", "anchor", "context"), ["doc_id", "v"])
        seen = seen.unionByName(inner.select("anchor", "context", "from", "to"))
        used.append(long)
    seen = written(seen, "seen")
    lists = seen.groupBy("anchor", "context").agg(F.collect_list(F.struct("from", "to")).alias("s"))
    firsts = written(contexts.select("anchor", "context", F.col("doc_id").alias("first")).join(lists, ["anchor", "context"], "left"), "firsts")
    own = F.coalesce("s", F.array().cast("array<struct<from:int,to:int>>"))
    all_of_it = F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to")))
    marks = met.join(firsts, ["anchor", "context"]).select("doc_id", "v", "lo", F.explode(F.when(F.col("doc_id") > F.col("first"), all_of_it).otherwise(own)).alias("m"))
    marks = marks.select("doc_id", "v", (F.col("lo") + F.col("m.from")).alias("from"), (F.col("lo") + F.col("m.to")).alias("to"))
    merged = written(_merged(marks), "spans")
    for t in (*used, seen, firsts):
        dropped(t)
    return merged


def _merged(marks: DataFrame) -> DataFrame:
    """doc_id, v and spans: overlapping and adjacent marks of a text as one."""
    order = "PARTITION BY doc_id, v ORDER BY `from`, `to`"
    opened = marks.withColumn("_o", F.expr(f"coalesce(`from` > max(`to`) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)"))
    numbered = opened.withColumn("_g", F.expr(f"count_if(_o) OVER ({order} ROWS UNBOUNDED PRECEDING)"))
    one = numbered.groupBy("doc_id", "v", "_g").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return one.groupBy("doc_id", "v").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))


def _kept(text: str, gone: list[tuple[int, int]]):
    """Of a text, piece by piece: all words' number, and the words that stay (bytes)."""
    raw, begin, at, i = text.encode("utf-8", "surrogatepass"), 0, 0, 0
    while begin < len(raw):
        end = begin + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = raw[begin:end].split()
        begin = end
        stay, here = [], at
        at += len(words)
        while i < len(gone) and gone[i][0] < at:
            lo, hi = gone[i]
            stay += words[here - at + len(words) : max(lo, here) - at + len(words)]
            here = max(here, min(hi, at))
            if hi > at:
                break
            i += 1
        stay += words[here - at + len(words) :]
        yield len(words), stay


def _finished(docs: DataFrame, of, schema: str, **bounds) -> DataFrame:
    """Each row of ``docs`` as ``of`` makes it of (doc_id, text, spans)."""
    found, total = repeated(docs, **bounds)
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches):
        for b in few_rows(batches):
            rows = [of(doc, text, [(s["from"], s["to"]) for s in spans or ()]) for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return _with_lists(_texts(docs), found, total, bounds.get("broadcast", BROADCAST_SPANS), "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def report(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words that stay, joined by one space) of each document.

    A null text has no words.  A null doc_id is neither earlier nor later than
    any other: its text stays.  Rows of one doc_id don't remove each other's
    words.  An empty table gives no rows; other columns are ignored.
    """

    def of(doc, text, gone):
        n = left = 0
        digest = hashlib.sha256()
        for words, stay in _kept(text, gone):
            if stay:
                digest.update(b" " * (left > 0) + b" ".join(stay))
            n += words
            left += len(stay)
        return doc, n, n - left, digest.hexdigest()

    return _finished(docs, of, "doc_id long, n_words long, n_removed long, kept_sha256 string", **bounds)


def deduplicate(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id and text: the words that stay, joined by one space (a text that loses nothing keeps its spacing)."""

    def of(doc, text, gone):
        return doc, b" ".join(b" ".join(stay) for _, stay in _kept(text, gone) if stay).decode("utf-8", "surrogatepass") if gone else text

    return _finished(docs, of, "doc_id long, text string", **bounds)


#: The report as DuckDB SQL over ``documents``.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER s AS win, count(*) OVER s AS c FROM p WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
h AS (SELECT doc_id, i, md5(win) AS h FROM g WHERE c = 50),
f AS (SELECT h, min(doc_id) AS m FROM h GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (h) WHERE m < doc_id),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
