"""Quality rules by compression bands.

Next to plain counts, each text is compressed with zstandard as a whole and in
chunks of ``CHUNK`` bytes, the last one as long as it comes.  A ratio (compressed
to plain bytes) below the limit for that length means repetitive text, above it
incompressible text; one table of limits by length serves texts and chunks, since
short pieces compress badly whatever they hold.  A text is kept if its counts
pass, its whole ratio lies in its band, and at most ``CHUNK_SHARE`` of its bytes
are in chunks outside theirs; a text of one chunk is judged by its whole ratio.

The upper limits lie above the 99.9 % point of prose at that length and below
base64 (0.85 at 512 bytes, 0.76 from 4 KB on) and random letters.

Defined results: null or empty text has no words, ratio 1, and fails the base
rule; repeated rows are judged alike; other columns are ignored by ``measure``
and passed through by ``filtered``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, groups, ngrams

LEVEL = 3
CHUNK = 512
CHUNK_SHARE = 0.25
#: (bytes below, least ratio, greatest ratio): fixed limits by length, for texts and chunks.
BANDS = (
    (128, 0.00, 99.0),
    (256, 0.00, 1.00),
    (384, 0.08, 0.82),
    (512, 0.08, 0.77),
    (1_024, 0.08, 0.74),
    (2_048, 0.08, 0.68),
    (4_096, 0.08, 0.66),
    (16_384, 0.08, 0.64),
    (1 << 62, 0.06, 0.64),
)
_SYMBOL = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def band(n: int) -> tuple[float, float]:
    """The limits for a text of n bytes."""
    return next((lo, hi) for below, lo, hi in BANDS if n < below)


def compression(raw: bytes, packer) -> tuple[float, float]:
    """The ratio of the whole, and the share of its bytes that lie in chunks outside their band."""
    if not raw:
        return 1.0, 0.0
    whole = len(packer.compress(raw)) / len(raw)
    if len(raw) <= CHUNK:
        lo, hi = band(len(raw))
        return whole, float(not lo <= whole <= hi)
    bad = 0
    for i in range(0, len(raw), CHUNK):
        c = raw[i : i + CHUNK]
        lo, hi = band(len(c))
        if not lo <= len(packer.compress(c)) / len(c) <= hi:
            bad += len(c)
    return whole, bad / len(raw)


def _repeats(w: Words) -> np.ndarray:
    """Per text: the words in three-word windows that its text holds twice or more."""
    s, off = ngrams(w.h, w.off, 3)
    n = np.diff(w.off)
    out = np.zeros(n.size, np.int64)
    if not s.size:
        return out
    doc = np.repeat(np.arange(n.size), np.diff(off))
    order = np.lexsort((s, doc))
    same = (s[order][1:] == s[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(s.size, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    first = at - off[doc[at]] + w.off[doc[at]]  # the window's first word
    hit = np.zeros(w.h.size, bool)
    for j in range(3):
        hit[first + j] = True
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[w.off[1:]] - total[w.off[:-1]]


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif _WORD.search(line):
            seen.add(line)
    return n


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def judge(texts: list) -> dict[str, list]:
    """The columns of ``measure`` for a list of texts."""
    out: dict[str, list] = {c.split()[0]: [] for c in _OUT.split(", ")}
    packer = zstandard.ZstdCompressor(level=LEVEL)
    with np.errstate(over="ignore"):
        for a, b in groups(texts):
            w = Words(texts[a:b], lower=False)
            n = np.diff(w.off)
            cont = np.concatenate([[0], np.cumsum((np.frombuffer(w.buf, np.uint8) & 0xC0) != 0x80)])
            chars = np.concatenate([[0], np.cumsum(cont[w.end] - cont[w.start])])
            chars = chars[w.off[1:]] - chars[w.off[:-1]]
            rep = _repeats(w)
            failed = (n < 50) | (100 * rep > 50 * n)
            out["n_words"] += n.tolist()
            out["word_chars"] += chars.tolist()
            out["n_repeat_words"] += rep.tolist()
            out["base_failed"] += failed.tolist()
            for t, f in zip(texts[a:b], failed.tolist(), strict=True):
                t = t or ""
                raw = t.encode("utf-8", "surrogatepass")
                whole, bad = compression(raw, packer)
                lo, hi = band(len(raw))
                out["ratio"].append(whole)
                out["bad_chunks"].append(bad)
                out["kept"].append(not f and lo <= whole <= hi and bad <= CHUNK_SHARE)
                out["n_symbols"].append(len(_SYMBOL.findall(t)))
                out["n_dup_lines"].append(_dup_lines(t))
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, ratio and bad_chunks of every row."""

    def run(batches):
        for b in batches:
            got = judge(b.column(1).to_pylist())
            cols = [b.column(0)] + [pa.array(v, pa.bool_() if k in ("kept", "base_failed") else pa.float64() if k in ("ratio", "bad_chunks") else pa.int64()) for k, v in got.items()]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *got])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {_OUT}")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(judge(b.column(at).to_pylist())["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
