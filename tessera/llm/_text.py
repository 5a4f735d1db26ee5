"""Vectorised word hashing shared by the operators.

A batch of texts becomes one byte buffer; every word gets a 64-bit hash with
numpy, so no Python object is made per word.  Words are maximal runs of bytes
other than ``[\\x20\\x09-\\x0D]`` (all ASCII, so UTF-8 bytes never collide).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in groups of about this many bytes (one text may exceed it).
GROUP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs get unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BYTE_WORD = np.where(_SPACE, np.uint64(0), _BYTE)
_BASE = 0xD6E8FEB86659FD93
_POW = {_BASE: np.ones(1, np.uint64), pow(_BASE, -1, 1 << 64): np.ones(1, np.uint64)}


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    """At least n powers of an odd base; grown on demand to the longest run seen."""
    out = _POW[base]
    while out.size < n:
        with np.errstate(over="ignore"):
            out = np.concatenate([out, out * (out[-1] * np.uint64(base))])
    _POW[base] = out
    return out


def _encode(texts: list) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


class Words:
    """The words of a group of texts, in order.

    ``h``: 64-bit hash of each word; ``off``: text i has words off[i]:off[i+1];
    ``start``, ``end``: byte range of each word in ``buf``.
    """

    __slots__ = ("h", "off", "start", "end", "buf", "doc_at")

    def __init__(self, texts: list, lower: bool = True):
        raw = _encode(texts)
        self.buf = b"\n".join(raw) + b"\n"
        a = np.frombuffer(self.buf, np.uint8)
        if lower:
            a = _LOWER[a]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.doc_at = np.concatenate([[0], np.cumsum(sizes)])
        space = _SPACE[a]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self.off = np.searchsorted(self.start, self.doc_at)
        self.h = hash_runs(a, self.start, _BYTE_WORD)

    def docs(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(self.off.size - 1), np.diff(self.off))


#: Bytes of a buffer whose places all have their power in a table.
PLACES = 1 << 21


def hash_runs(a: np.ndarray, start: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A hash of each run that begins at ``start`` and lasts to the next start; bytes that map to 0 at its end count for nothing."""
    if not start.size:
        return np.empty(0, np.uint64)
    v = byte[a]
    if a.size <= PLACES:  # powers of the place in the buffer, less the run's own place
        v *= _powers(a.size)[: a.size]
        return mix(np.add.reduceat(v, start) * _powers(a.size, pow(_BASE, -1, 1 << 64))[start])
    at = np.zeros(a.size, np.int64)
    at[start] = start
    rel = np.arange(a.size)
    rel -= np.maximum.accumulate(at)
    longest = int(np.max(np.diff(np.append(start, a.size))))
    first = int(start[0])
    v *= _powers(max(longest, first + 1))[rel]
    return mix(np.add.reduceat(v, start))


def groups(texts: list, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about ``most`` characters each."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


#: Functions that drop what a worker remembers for one operator.
MEMORIES: list = []


def few_rows(batches, rows: int = 512, keep=None):
    """Arrow batches cut into pieces of a few rows, so that only few texts become Python strings at once.  Workers live on: what they remember for other operators goes at the beginning (all MEMORIES but ``keep``), and what the task held goes back to the system at the end."""
    for forget in MEMORIES:
        if forget is not keep:
            forget()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def ngrams(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and their offsets by text."""
    n = np.diff(off)
    m = np.maximum(n - k + 1, 0)
    new = np.concatenate([[0], np.cumsum(m)])
    if h.size < k or not new[-1]:
        return np.empty(0, np.uint64), new
    s = h[: h.size - k + 1].copy()
    for j in range(1, k):
        s = s * np.uint64(0x9FB21C651E98DF25) + h[j : h.size - k + 1 + j]
    keep = np.ones(s.size, bool)
    for j in range(1, k):  # windows that would run over the end of a text
        at = off[1:-1] - j
        at = at[(at >= 0) & (at < s.size)]
        keep[at] = False
    return mix(s[keep]), new


def shingle_sets(w: Words, k: int = 5) -> Iterator[np.ndarray]:
    """The distinct k-word shingles of each text, sorted; a text of fewer words has its whole sequence as one; none for no words."""
    s, off = ngrams(w.h, w.off, k)
    for i in range(off.size - 1):
        n = w.off[i + 1] - w.off[i]
        if n >= k:
            yield np.unique(s[off[i] : off[i + 1]])
        elif n:
            v = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in w.h[w.off[i] : w.off[i + 1]]:
                    v = v * np.uint64(0x9FB21C651E98DF25) + x
            yield mix(np.array([v], np.uint64))
        else:
            yield np.empty(0, np.uint64)
