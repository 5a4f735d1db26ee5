"""SentencePiece encoding as a max-plus parallel scan, and decoding.

The ids are those of the model's byte-pair merges.  A token sequence is the
merge result of its text exactly if every two neighbours are the merge result
of theirs, so encoding is a path through the lattice of pieces in which a step
weighs 0 where the pair fits and minus infinity where it doesn't, and the best
path is the only one that is not minus infinity.  No piece holds a space after
another character and none runs over a line's end, so the starts of words and of lines
are forced cuts, and whole words are solved once and remembered.

Every text is split into chunks of ``CHUNK`` characters, wherever a chunk's end
falls.  Inside a word an end is *open*: a piece may run over it.  The state at an
open end is the piece that reaches or crosses it.  Each chunk gives a transfer
matrix of path weights from entry state to exit state; the matrices combine
associatively, in a tree, in the (max, +) semiring; that fixes the states at all
ends, and each chunk is then traced back on its own.  A text of more than
``PART`` characters is split into parts first, on forced cuts where it has any
(a stretch without a space that is longer than a part has open ends); the split,
the matrices and the traces of its parts run as separate Spark rows, so one giant
document spreads over the cluster, and only the small matrices of a document meet.

Spaces map to the piece marker and one is put in front; a character that no
piece holds becomes the byte pieces of its UTF-8 form, the marker itself
included, so decoding gives back every text exactly.

Defined results: null text has null ids; the empty text has no ids; repeated
rows are encoded alike; other columns pass through ``encode_documents``
unchanged.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import unused, written
from ._text import MEMORIES, few_rows

#: Characters in a chunk of a text.
CHUNK = 1 << 12
#: The longest word in which a chunk ends; a longer one stays whole.
WORD = 64
#: Characters in a part of a giant text, which is one Spark row.
PART = 1 << 16
#: Words whose pieces a worker remembers; beyond that, those that did not come up since the last time go.
MEMORY = 200_000
#: Pairs of pieces whose fit a worker remembers.
PAIRS = 300_000
_SEGMENT = re.compile(" +[^ ]*|^[^ ]+")
_NEVER = float("-inf")


def default_model() -> str:
    """The piece model of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and scores of a SentencePiece model file, with spaces for its marker."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[int, float]] = {}
        self.raw: list[bytes] = []
        self.text: list[str] = []
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
                self.text.append("")
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
                self.text.append("")
            else:
                text = piece.replace("▁", " ")
                if " " in text.lstrip(" "):
                    raise ValueError("a piece holds a space after another character: words can't be cut apart")
                self.score[text] = (i, float(sp.get_score(i)))
                self.raw.append(text.encode())
                self.text.append(text)
        if any("\n" in t[:-1] or "\n" in t[1:] for t in self.score):
            raise ValueError("a piece runs over a line's end: lines can't be cut apart")
        self.code = {t: i.to_bytes(4, "little") for t, (i, _) in self.score.items()}
        self.longest = max(map(len, self.score))
        #: every beginning of a piece, and whether it is a piece itself
        self.begins = {t[:i]: False for t in self.score for i in range(1, len(t) + 1)} | dict.fromkeys(self.score, True)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[str | None, dict[str, bool]] = {}
        self.n_pairs = 0

    def merge(self, text: str) -> list[str]:
        """The merge result of a short text: again and again the best-scored pair, the first of equals."""
        s, score = list(text), self.score
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                found = score.get(s[i] + s[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def fits(self, a: str | None, b: str) -> bool:
        """Whether b may follow a (None: begin a word)."""
        ok = self.merge((a or "") + b) == ([b] if a is None else [a, b])
        if self.n_pairs >= PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.pairs.setdefault(a, {})[b] = ok
        self.n_pairs += 1
        return ok

    def lattice(self, text: str, inner: int, start: int = 0, before: str | None = None) -> list[str | None]:
        """The piece that ends at each place on the path from ``start``, where ``before`` ends; pieces begin before ``inner``.  None: no path."""
        n, begins, pairs = len(text), self.begins, self.pairs
        last: list[str | None] = [None] * (n + 1)
        top = start
        for p in range(start, inner if inner < n else n):
            here = last[p]
            if here is None:
                if p > top:
                    break
                if p != start:
                    continue
                here = before
            row = pairs.get(here)
            if row is None:
                row = pairs[here] = {}
            for q in range(p + 1, n + 1):
                t = text[p:q]
                if t in begins:
                    if last[q] is None and (begins[t] or q == p + 1):
                        if row[t] if t in row else self.fits(here, t):
                            last[q] = t
                            if q > top:
                                top = q
                else:
                    if q == p + 1 and (row[t] if t in row else self.fits(here, t)):
                        last[q] = t
                        if q > top:
                            top = q
                    break
        return last

    def trace(self, last: list[str | None], end: int, start: int = 0) -> list[int]:
        out: list[list[int]] = []
        while end > start:
            t = last[end]
            found = self.score.get(t)
            out.append([found[0]] if found else [self.byte[b] for b in t.encode("utf-8", "surrogatepass")])
            end -= len(t)
        return [i for ids in reversed(out) for i in ids]

    def pieces_at(self, w: str, p: int) -> list[str]:
        """The pieces that begin at ``p``, the shortest first; a single character always counts as one."""
        begins, n, q = self.begins, len(w), p + 1
        t = w[p:q]
        out = [t]
        while q < n and t in begins:
            q += 1
            t = w[p:q]
            if begins.get(t):
                out.append(t)
        return out

    def solve(self, w: str) -> bytes:
        """The ids of a segment that begins with a space or a line's end, as int32 bytes.

        The finite path through the segment's lattice, found from the longest
        pieces first.  Only one piece can reach a place, so a place from which
        the path does not go on is never entered again.
        """
        n, p, pairs = len(w), 0, self.pairs
        path: list[str] = []
        todo: list[list[str]] = []  # the pieces yet to try after each beginning of the path
        dead: set[int] = set()
        options = self.pieces_at(w, 0)
        while p < n:
            here = path[-1] if path else None
            row = pairs.get(here)
            if row is None:
                row = pairs[here] = {}
            while options:
                t = options.pop()
                if p + len(t) not in dead and (row[t] if t in row else self.fits(here, t)):
                    path.append(t)
                    todo.append(options)
                    p += len(t)
                    options = self.pieces_at(w, p) if p < n else []
                    break
            else:
                dead.add(p)
                p -= len(path.pop())
                options = todo.pop()
        code = self.code
        return b"".join([code[t] if t in code else self.spelled(t) for t in path])

    def spelled(self, t: str) -> bytes:
        """The byte pieces of a character that no piece holds, as int32 bytes."""
        return np.array([self.byte[b] for b in t.encode("utf-8", "surrogatepass")], np.int32).tobytes()

    def word(self, bare: str) -> bytes:
        """The ids of a word (the space before it left out; or a line's end and the word right after it), remembered.

        A mark at the end of a known word needs no lattice: the path of the
        word goes on with the mark if the two last pieces fit.
        """
        got = self.known.get(bare)
        if got is None:
            got = self.older.get(bare)
            if got is None and bare and not bare[-1].isalnum():
                stem, mark = bare[:-1], self.code.get(bare[-1])
                before = self.known.get(stem) or self.older.get(stem)
                if before and mark:
                    last = self.text[int.from_bytes(before[-4:], "little")]
                    row = self.pairs.get(last, {})
                    if last and (row[bare[-1]] if bare[-1] in row else self.fits(last, bare[-1])):
                        got = before + mark
            if got is None:
                got = self.solve(bare if bare[:1] == "\n" else " " + bare)
            if len(self.known) >= MEMORY:
                self.older, self.known = self.known, {}
            if len(bare) <= 64:
                self.known[bare] = got
        return got

    def words(self, text: str) -> bytes:
        """The ids of " " + text.  No piece runs over a line's end, so every line begins at a forced cut, too."""
        first, *lines = text.split("\n")
        got: list[bytes] = []
        for line in [first, *["\n" + x for x in lines]]:
            parts = line.split(" ")
            if "" in parts:  # several spaces together, or one before a line's end
                at = line if line[:1] == "\n" else " " + line
                got += [self.solve(w) if w[:2] == "  " or w == " " else self.word(w[1:] if w[0] == " " else w) for w in _SEGMENT.findall(at)]
                continue
            found = list(map(self.known.get, parts))
            if None in found:
                for i, g in enumerate(found):
                    if g is None:
                        found[i] = self.word(parts[i])
            got += found
        return b"".join(got)

    # -- parts of giant texts --

    def states(self, behind: str, ahead: str) -> list[tuple[str, int]]:
        """Pieces that reach or cross an end between two texts, with the characters they take from the second."""
        both, e = behind + ahead, len(behind)
        out = []
        for s in range(max(0, e - self.longest), e):
            for x in range(e, min(len(both), s + self.longest) + 1):
                if x == s + 1 or both[s:x] in self.score:
                    out.append((both[s:x], x - e))
        return out

    def _ends(self, part: tuple) -> tuple[list, list]:
        text, behind, look = part
        near = text[-self.longest :] if len(text) >= self.longest else behind + text
        return (self.states(behind, text[: self.longest]) if behind else [(None, 0)]), (self.states(near, look) if look else [(None, 0)])

    def matrix(self, text: str, behind: str, look: str) -> np.ndarray:
        """(entries, exits) path weights through a part; ``behind`` and ``look`` lie beyond its open ends."""
        if not behind and not look:  # between forced cuts there is always a path
            return np.zeros((1, 1))
        entries, exits = self._ends((text, behind, look))
        m = np.full((len(entries), len(exits)), _NEVER)
        segs = _SEGMENT.findall(text)
        whole = len(segs) == 1
        first = text + look if whole else segs[0]
        if not whole:
            tail = segs[-1] + look
            last = self.lattice(tail, len(segs[-1]))
            out = np.array([0.0 if self._leaves(last, len(segs[-1]), t, k) else _NEVER for t, k in exits])
        for i, (before, a) in enumerate(entries):
            if a > len(segs[0]):
                continue
            last = self.lattice(first, len(segs[0]), a, before)
            if whole:
                m[i] = [0.0 if self._leaves(last, len(text), t, k) else _NEVER for t, k in exits]
            elif a == len(segs[0]) or last[len(segs[0])] is not None:
                m[i] = out
        return m

    @staticmethod
    def _leaves(last: list, n: int, t: str | None, k: int) -> bool:
        return last[n] is not None if t is None else n + k < len(last) and last[n + k] == t

    def through(self, text: str, behind: str, look: str, entry: int, leave: int) -> bytes:
        """Ids of a part between fixed states."""
        if not behind and not look:
            return self.words(text[1:])
        entries, exits = self._ends((text, behind, look))
        (before, a), (_, k) = entries[entry], exits[leave]
        segs = _SEGMENT.findall(text)
        if len(segs) == 1:
            ids = self.trace(self.lattice(text + look, len(text), a, before), len(text) + k, a)
            return np.array(ids, np.int32).tobytes()
        first, tail = segs[0], segs[-1] + look
        return b"".join(
            [
                np.array(self.trace(self.lattice(first, len(first), a, before), len(first), a), np.int32).tobytes(),
                self.words("".join(segs[1:-1])[1:]) if len(segs) > 2 else b"",
                np.array(self.trace(self.lattice(tail, len(segs[-1])), len(segs[-1]) + k), np.int32).tobytes(),
            ]
        )

    def trim(self) -> None:
        """Keeps the words that came first, which are the common ones, so that a worker that goes on with other work holds little."""
        self.known, self.older = dict(islice((self.older | self.known).items(), MEMORY // 2)), {}

    def decode(self, ids) -> str:
        raw = self.raw
        s = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return s[1:] if s.startswith(" ") else s


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def forget() -> None:
    """Drops the vocabularies that this process holds."""
    vocabulary.cache_clear()


MEMORIES.append(forget)


def split(text: str, part: int, longest: int) -> list[tuple[str, str, str]]:
    """(part, behind, look) of " " + text; what lies behind and ahead is given at open ends only."""
    s = " " + text
    out, begin, was_open = [], 0, False
    while begin < len(s):
        end = begin + part
        opened = False
        if len(s) - end <= longest:
            end = len(s)
        else:
            cut = s.rfind(" ", begin + 1, end + 1)
            while cut > begin and s[cut - 1] == " ":
                cut -= 1
            if cut > begin + longest:
                end = cut
            else:
                opened = True
        out.append((s[begin:end], s[max(0, begin - longest) : begin] if was_open else "", s[end : end + longest] if opened else ""))
        begin, was_open = end, opened
    return out


def chunks(text: str, size: int, longest: int) -> list[tuple[str, str, str]]:
    """(chunk, behind, look) of " " + text, as ``split``, with ends inside words where they fall there."""
    s = " " + text
    out, begin, was_open = [], 0, False
    while begin < len(s):
        end, opened = begin + size, True
        if len(s) - end <= longest:
            end, opened = len(s), False
        else:
            left = s.rfind(" ", max(begin, end - WORD) + 1, end + 1)  # the space before the word in which the end falls
            right = s.find(" ", end, end + WORD)
            if s[end] == " ":
                opened, run = False, end
                while run > begin and s[run - 1] == " ":
                    run -= 1
                if run > begin + longest:
                    end = run
                else:  # a long run of spaces stays whole, with the word after it
                    while end < len(s) and s[end] == " ":
                        end += 1
                    cut = s.find(" ", end)
                    end = len(s) if cut < 0 else cut
            elif left < 0 or right < 0 or right - left > WORD:
                cut = s.find(" ", end)
                end, opened = (len(s) if cut < 0 else cut), False
        out.append((s[begin:end], s[max(0, begin - longest) : begin] if was_open else "", s[end : end + longest] if opened else ""))
        begin, was_open = end, opened
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product: the best path through two parts for every entry of the first and exit of the second."""
    return (a[:, :, None] + b[None]).max(axis=1)


def combine(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The state numbers (entry, exit) of every part on the best path, from the parts' matrices in order.

    Up a binary tree of products, then down again: a node whose entry and exit
    are fixed fixes the state between its halves.  Any bracketing gives the same.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([product(m[i], m[i + 1]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
    states = [(0, int(np.argmax(levels[-1][0][0])))]
    for m in reversed(levels[:-1]):
        below = []
        for i, (entry, leave) in enumerate(states):
            if 2 * i + 1 == len(m):
                below.append((entry, leave))
            else:
                mid = int(np.argmax(m[2 * i][entry] + m[2 * i + 1][:, leave]))
                below += [(entry, mid), (mid, leave)]
        states = below
    return states


def scan(v: Vocabulary, parts: list[tuple[str, str, str]]) -> bytes:
    """The ids of a text's parts, as int32 bytes: matrices, their products, traces."""
    states = combine([v.matrix(*p) for p in parts])
    return b"".join([v.through(t, behind, look, a, b) for (t, behind, look), (a, b) in zip(parts, states, strict=True)])


def ids_of(v: Vocabulary, text: str, size: int = CHUNK) -> tuple[bytes, int]:
    """The ids of a text as int32 bytes, and its number of chunks."""
    if not text:
        return b"", 1
    parts = chunks(text, size, v.longest)
    return scan(v, parts), len(parts)


def encode(text: str | None, path: str, part: int = PART) -> np.ndarray | None:
    """Ids of one text, by the same steps as the Spark job's for a giant text."""
    if text is None:
        return None
    v = vocabulary(path)
    return np.frombuffer(scan(v, split(text, part, v.longest)) if text else b"", np.int32)


def _lists(ids: list) -> pa.Array:
    """Int32 bytes (or None) as an Arrow list array."""
    sizes = np.fromiter((len(x) // 4 if x else 0 for x in ids), np.int64, len(ids))
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    missing = np.fromiter((x is None for x in ids), bool, len(ids))
    values = pa.array(np.frombuffer(b"".join(x for x in ids if x), np.int32))
    return pa.ListArray.from_arrays(pa.array(off, mask=np.append(missing, False)), values)


def _add(batch, **more):
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


ADDED = ("ids", "n_ids", "n_parts")


def encode_documents(docs: DataFrame, path: str | None = None, part: int = PART) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), ``n_ids`` and ``n_parts`` of ``text``; columns of these names are replaced."""
    path = path or default_model()
    docs = docs.drop(*ADDED)
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", ids array<int>, n_parts int"

    def short(batches):
        v = vocabulary(path)
        for b in few_rows(batches, keep=forget):
            found = [(None, 1) if t is None else ids_of(v, t) for t in b.column(at).to_pylist()]
            yield _add(b, ids=_lists([x for x, _ in found]), n_parts=pa.array([n for _, n in found], pa.int32()))
        v.trim()

    def cut(batches):
        longest = vocabulary(path).longest
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = split(text, part, longest)
                for a in range(0, len(parts), 64):
                    some = parts[a : a + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array(range(a, a + len(some)), pa.int32()), pa.array([p[0] for p in some]), pa.array([p[1] for p in some]), pa.array([p[2] for p in some])],
                        names=["_row", "no", "part", "behind", "look"],
                    )

    def matrices(batches):
        v = vocabulary(path)
        for b in batches:
            found = [v.matrix(*p) for p in zip(*(b.column(c).to_pylist() for c in ("part", "behind", "look")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("no"), pa.array([m.shape[1] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], names=["_row", "no", "exits", "m"])

    def states(pdf):
        pdf = pdf.sort_values("no")
        found = combine([np.frombuffer(m, float).reshape(-1, e) for m, e in zip(pdf.m, pdf.exits, strict=True)])
        return pdf[["_row", "no"]].assign(entry=[a for a, _ in found], leave=[b for _, b in found])

    def traces(batches):
        v = vocabulary(path)
        for b in batches:
            ids = [v.through(*p) for p in zip(*(b.column(c).to_pylist() for c in ("part", "behind", "look", "entry", "leave")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("no"), _lists(ids)], names=["_row", "no", "ids"])

    giant = F.coalesce(F.length("text") > part, F.lit(False))
    out = docs.where(~giant).mapInArrow(short, schema)
    row = unused("row", docs)
    long = written(docs.where(giant).withColumn(row, F.monotonically_increasing_id()), "giants")
    if not long.isEmpty():
        parts = written(long.select(F.col(row).alias("_row"), "text").mapInArrow(cut, "_row long, no int, part string, behind string, look string").repartition("_row", "no"), "parts")
        solved = parts.mapInArrow(matrices, "_row long, no int, exits int, m binary").groupBy("_row").applyInPandas(states, "_row long, no int, entry int, leave int")
        traced = parts.join(solved, ["_row", "no"]).mapInArrow(traces, "_row long, no int, ids array<int>")
        joined = traced.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("_p"))
        many = long.join(joined.withColumnRenamed("_row", row).withColumnRenamed("_p", f"{row}_parts"), row).select(*docs.columns, F.flatten(F.col(f"{row}_parts.ids")).alias("ids"), F.size(f"{row}_parts").alias("n_parts"))
        out = out.union(many)
    return out.select(*docs.columns, "ids", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_ids"), "n_parts")


def decode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``, the text of its ``ids``; null ids give null."""
    path = path or default_model()
    docs = docs.drop("decoded")
    at = docs.columns.index("ids")

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            yield _add(b, decoded=pa.array([None if x is None else v.decode(x) for x in b.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", decoded string")


def digest(docs: DataFrame, path: str | None = None, part: int = PART) -> DataFrame:
    """doc_id, n_ids, n_parts, ids_sha256 (of the ids as little-endian int32), round_trip (whether decoding gives the text back).

    Texts of one part are encoded, decoded and digested in one pass, chunk by
    chunk; those of several parts go through ``encode_documents``.
    """
    path = path or default_model()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_ids long, n_parts int, ids_sha256 string, round_trip boolean"

    def rows(v, doc_ids, texts, ids, n_parts):
        sha = [None if x is None else hashlib.sha256(x).hexdigest() for x in ids]
        same = [None if x is None else v.decode(np.frombuffer(x, np.int32).tolist()) == t for x, t in zip(ids, texts, strict=True)]
        n = pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64())
        return pa.RecordBatch.from_arrays([doc_ids, n, n_parts, pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "n_parts", "ids_sha256", "round_trip"])

    def short(batches):
        v = vocabulary(path)
        for b in few_rows(batches, keep=forget):
            texts = b.column(1).to_pylist()
            found = [(None, 1) if t is None else ids_of(v, t) for t in texts]
            yield rows(v, b.column(0), texts, [x for x, _ in found], pa.array([n for _, n in found], pa.int32()))
        v.trim()

    def long(batches):
        v = vocabulary(path)
        for b in few_rows(batches, keep=forget):
            lists = b.column(2)
            ids = [lists[i].values.to_numpy(zero_copy_only=False).astype("<i4").tobytes() for i in range(len(lists))]
            yield rows(v, b.column(0), b.column(1).to_pylist(), ids, b.column(4))

    giant = F.coalesce(F.length("text") > part, F.lit(False))
    many = encode_documents(d.where(giant), path, part).select("doc_id", "text", "ids", "n_ids", "n_parts")
    return d.where(~giant).mapInArrow(short, schema).union(many.mapInArrow(long, schema))
