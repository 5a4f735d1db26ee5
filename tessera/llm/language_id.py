"""Language identification: averaged hashed subword embeddings under a linear softmax.

The subwords of a text are the character n-grams of length 1 to 3 inside its
words (a word's edges count as a character; ASCII digits and marks are edges),
hashed into ``BUCKETS``.  A text's
vector is the mean embedding of its subwords, and a linear softmax over it
gives the language.  Embeddings and softmax are trained together by stochastic
gradient descent in numpy on whole texts and on random stretches of them, so
that short texts are known too.  A second part of the sample, not trained on,
calibrates the rejection.  It sets the temperature and the score below which a
prediction is rejected: at most ``REJECT_RATE`` of its right predictions fall
below it, by their order and, where they are few, by an exponential tail with
the mean of the language that is least sure.  A softmax is sure of text in no language, too, so the share of a
text's three-character subwords that training never saw is limited as well:
halfway between the share that ``REJECT_RATE`` of the calibration texts exceed and
the share that ``FOREIGN_RATE`` of them stay under when the subwords of their
own language are taken out of what was seen, as if it had not been learned.
Foreign scripts, languages that were not learned and random letters lie far
above the limit; clean texts of the learned languages lie below it.

The sample is bounded: about ``SAMPLE`` labelled rows of each language, chosen
by a hash of the id.  Everything else reads every row whole.

Defined results: null text or a text without a letter is ``und`` with score 0
and counts as rejected; repeated rows are predicted alike; with no labelled row
every text is ``und``; other columns are ignored or passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import few_rows, groups

BUCKETS = 1 << 15
WIDTH = 16
#: Bits of the slots in which the model notes the three-character subwords that it has seen.
SLOTS = 20
SAMPLE = 600
REJECT_RATE = 0.0005
FOREIGN_RATE = 0.05
EPOCHS = 8
#: Characters whose subwords are held at once; the scores of a longer text are summed in stretches.
GROUP = 1 << 18
_NO_LETTER = np.array([not chr(i).isalpha() for i in range(128)] + [False])
_LETTER = regex.compile(r"\p{L}")


def subwords(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all subwords of the texts, where each text's begin and end, and the same for the slots of the three-character ones alone."""
    parts = [" ".join(t.lower().split()) if t else "" for t in texts]
    joined = " " + " ".join(parts) + " "  # a space on both sides of each text
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    c[_NO_LETTER[np.minimum(c, 128).astype(np.int64)]] = 32
    gap = c == 32
    c *= np.uint64(0x9E3779B97F4A7C15)
    c ^= c >> np.uint64(29)
    one = c[1:]
    two = c[:-1] * np.uint64(31) + one  # ends at 1 ...
    three = (c[:-2] * np.uint64(961) + two[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    grams = np.full((one.size, 3), -1, np.int32)
    shift = np.uint64(64 - 15)
    grams[:, 0] = (one * np.uint64(0x94D049BB133111EB)) >> shift
    grams[:, 1] = (two * np.uint64(0x94D049BB133111EB)) >> shift
    grams[1:, 2] = three >> shift
    inside = ~gap[1:]
    grams[~inside, 0] = -1
    grams[~inside & gap[:-1], 1] = -1
    grams[1:, 2][gap[1:-1]] = -1  # no n-gram runs over the space between two words
    ok = grams.ravel() >= 0
    at = np.minimum(at, one.size)
    off = np.concatenate([[0], np.cumsum(ok)])[at * 3]
    long = grams[:, 2] >= 0
    slots = (three >> np.uint64(64 - SLOTS)).astype(np.int64)[long[1:]]
    return grams.ravel()[ok], off, slots, np.concatenate([[0], np.cumsum(long)])[at]


class Model:
    """Per-bucket class scores (embedding times softmax weights), bias, temperature and threshold; the slots seen in training and the limit of unseen ones."""

    def __init__(self, labels, table, bias):
        self.labels, self.table, self.bias = labels, table.astype(np.float32), bias.astype(np.float32)
        self.temperature, self.threshold = 1.0, 0.0
        self.seen, self.limit = np.ones(1 << SLOTS, bool), 1.0

    def logits(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The class scores of each text, and its share of unseen subwords."""
        out, strange = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for a, b in groups(texts, GROUP):
            g, off, slots, at = subwords(texts[a:b])
            strange[a:b] = _share(~self.seen[slots], at)
            n = np.diff(off)
            full = np.flatnonzero(n)
            if b - a == 1 and n[0] > 2 * GROUP:
                out[a] = sum(self.table[g[i : i + GROUP]].sum(axis=0, dtype=float) for i in range(0, int(n[0]), GROUP)) / n[0] + self.bias
            elif full.size:
                out[a + full] = np.add.reduceat(self.table[g], off[:-1][full], axis=0) / n[full, None] + self.bias
        return out, strange

    def predict(self, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
        """Label, calibrated score and rejection of each text."""
        und = np.array([not (t and _LETTER.search(t)) for t in texts], bool)
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        with np.errstate(over="ignore"):
            z, strange = self.logits(texts)
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(und, 0.0, p[np.arange(len(texts)), best])
        return ["und" if u else self.labels[i] for u, i in zip(und, best, strict=True)], score, und | (score < self.threshold) | (strange > self.limit)


def _share(hit: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The share of hits between each two offsets; 0 where nothing lies between them."""
    total = np.concatenate([[0], np.cumsum(hit)])[off]
    return np.diff(total) / np.maximum(np.diff(off), 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pieces(texts: list, y: list, rng, most: int) -> tuple[list, list]:
    """Each text whole, and two random stretches of its words."""
    out, lab = [], []
    for t, k in zip(texts, y, strict=True):
        out.append(t)
        lab.append(k)
        words = t.split()
        for _ in range(2):
            n = int(rng.integers(1, most))
            a = int(rng.integers(0, max(1, len(words) - n + 1)))
            out.append(" ".join(words[a : a + n]))
            lab.append(k)
    return out, lab


def train(texts: list, langs: list, seed: int = 7) -> Model:
    """A model of labelled texts; every fifth text calibrates it and is not trained on."""
    labels = sorted(set(langs))
    y = [labels.index(x) for x in langs]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    fit, cal = [i for i in order if i % 5], [i for i in order if i % 5 == 0]
    fit, cal = fit or cal, cal or fit
    bits, lab = _pieces([texts[i] for i in fit], [y[i] for i in fit], rng, 40)
    lab = np.array(lab)
    with np.errstate(over="ignore"):
        bags = []
        by_lang = np.zeros((len(labels), 1 << SLOTS), bool)  # the slots that each language holds
        for a, b in groups(bits, GROUP):
            g, off, slots, at = subwords(bits[a:b])
            for i in range(b - a):
                u, n = np.unique(g[off[i] : off[i + 1]], return_counts=True)
                bags.append((u, (n / max(1, n.sum())).astype(np.float32)))
                by_lang[lab[a + i], slots[at[i] : at[i + 1]]] = True
    held = by_lang.sum(axis=0, dtype=np.int32)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w, bias = np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    w += rng.normal(0, 0.1, w.shape)
    size = 32
    steps = EPOCHS * -(-len(bags) // size)
    step = 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(bags))
        for a in range(0, len(mixed), size):
            rate = 2.0 * (1 - step / steps)
            step += 1
            own = mixed[a : a + size]
            col = np.concatenate([bags[i][0] for i in own])
            val = np.concatenate([bags[i][1] for i in own])
            used, at = np.unique(col, return_inverse=True)
            x = np.zeros((own.size, used.size), np.float32)
            x[np.repeat(np.arange(own.size), [bags[i][0].size for i in own]), at] = val
            e = emb[used]
            h = x @ e
            d = _softmax(h @ w + bias)
            d[np.arange(own.size), lab[own]] -= 1
            d /= own.size
            dh = d @ w.T
            w -= rate * (h.T @ d)
            bias -= rate * 0.1 * d.sum(axis=0)
            emb[used] = e - rate * 20 * (x.T @ dh)
    model = Model(labels, emb @ w, bias)
    model.seen = held > 0
    whole = [texts[i] for i in cal]
    bits, lab = _pieces(whole, [y[i] for i in cal], rng, 40)
    with np.errstate(over="ignore"):
        (z, strange), lab = model.logits(bits), np.array(lab)
        _, _, slots, at = subwords(whole)
    scale = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(_softmax(z / s)[np.arange(lab.size), lab], 1e-12)).mean() for s in scale]
    model.temperature = float(scale[int(np.argmin(loss))])
    z, lab, strange = z[::3], lab[::3], strange[::3]  # rejection is set on whole texts
    p = _softmax(z / model.temperature)
    tail = -np.log(REJECT_RATE)  # so many means out lies that point of an exponential tail: a few texts alone can't show it
    sure = p[np.arange(lab.size), lab]
    right = np.flatnonzero(p.argmax(axis=1) == lab)
    if right.size:
        worst = max((1 - sure[right[lab[right] == k]]).mean() for k in np.unique(lab[right]))
        model.threshold = float(min(np.sort(sure[right])[int(REJECT_RATE * right.size)], 1 - tail * worst))
    foreign = []
    for i, k in enumerate(lab.tolist()):
        some = slots[at[i] : at[i + 1]]
        foreign.append(float((held[some] == by_lang[k, some]).mean()) if some.size else 1.0)
    common = float(max(np.sort(strange)[::-1][int(REJECT_RATE * strange.size)], tail * strange.mean()))
    apart = float(np.quantile(foreign, FOREIGN_RATE)) if len(labels) > 1 else 1.0
    model.limit = max(common, (common + apart) / 2)
    return model


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2; a null id is never learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame) -> Model:
    """A model from at most about SAMPLE labelled rows of each language that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out()).where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE / n))])
    pick = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(pick < share[F.col("lang")]).select("doc_id", "text", "lang").toPandas().sort_values(["doc_id", "lang", "text"])
    got = got[[bool(_LETTER.search(t)) for t in got.text]]
    if not len(got):
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    return train(got.text.tolist(), got.lang.tolist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in few_rows(batches):
            label, score, gone = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(gone)], names=["doc_id", "lang_pred", "score", "rejected"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    p = predict(docs, fit(docs))
    return p.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language prediction is rejected; the columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    def run(batches):
        for b in few_rows(batches):
            gone = shared.value.predict(b.column(at).to_pylist())[2]
            yield b.filter(pa.array(~gone))

    return docs.mapInArrow(run, docs.schema)
