"""Near-equal lines across a corpus: one occurrence of each connected group stays.

A line is normalised: lower case, words joined by one space.  Equal normalised
lines are one class.  Two classes are linked when their edit similarity in words,
``1 - levenshtein / words of the longer``, is at least ``SIMILARITY``.

The fingerprint of a line is a SimHash in blocks: every word belongs to one block
by its hash, and a block is the 64-bit SimHash of the line's words that belong to
it.  An edit of a word changes two blocks at most (that of the word that goes and
that of the word that comes), so by the pigeonhole principle lines of few edits
have whole blocks in common, and lines meet on equal blocks.  Lines whose longer
one has up to 13 words can differ by one edit: of their four blocks two stay
whole, and they meet on pairs of blocks; up to 19 words, by two edits, of five
blocks one stays whole: none of these is missed.  Longer lines have so many blocks
that three words or four belong to each, of which the most edits allowed leave
three in ten whole, and up to ``KEYED`` blocks are keys; fewer edits leave more.  A line of fewer than six words
resembles no other, since one edit is too much.  Pairs that meet are compared if
their SimHashes of all distinct words differ in at most ``RADIUS`` of 64 bits, which
three edits in twenty hardly ever exceed; members of a crowded block, all of which
are compared, by a SimHash of 256 bits, in no more than the most edits allowed at
their length change in nine of ten cases (fewer edits: in nearly all); members that
this leaves meet again in their blocks, there with 16 bits of each word's hash.  The
edit similarity decides.  The first
occurrence by (doc_id, line number) of a connected group stays; every other one goes.

Defined results: lines of fewer than ``MIN_CHARS`` normalised characters always
stay, blank ones too; null texts stay null and have no lines; rows with a null
doc_id are left as they are; repeated rows of a doc_id count as one document (of
several texts under one doc_id each has its own lines at the same numbers);
other columns pass through.
"""

from __future__ import annotations

import itertools
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import dropped, only, small_enough, unused, written
from ._text import Words, few_rows, groups, mix

MIN_CHARS = 8
RADIUS = 18
SIMILARITY = 0.85
#: Blocks of a long line that are keys: the most edits allowed leave one of them whole with probability 0.95.
KEYED = 11
WINDOW = 8  # members of a key that are compared exhaustively in passing; beyond that with the pivot first
BLOCK = 4096
STRIP = 1 << 18  # pairs of members that are compared at once
PAIRS = 4_000_000  # pairs whose words are on disk at once
#: Lines whose numbers may be broadcast, 12 bytes each and a document's share.
BROADCAST_LINES = 2_000_000
SIMS = ("sim", "sim1", "sim2", "sim3")
#: Words of a line that meets others in a crowded block with its words; longer ones meet by fingerprints alone and are decided later.
SHORT = 512
DECIDED = 1 << 16  # pairs of members whose words are compared at once
#: Pairs in one banded table, and words of the longest line in one; longer lines are compared one by one.
TABLES, TABLED = 2048, 2048
#: Members of a group that is compared together with others of its kind.
FEW = 128
#: Lines whose words are sorted at once: their number and 46 bits of a word's hash fit into one integer.
LINES = 1 << 18


def most_edits(n: int) -> int:
    """Edits that two lines, the longer of n words, may differ by."""
    return int((1 - SIMILARITY) * n + 1e-9)


#: (fewest words of the longer line, blocks, blocks in a key) by length, half as long again each time.
SCHEMES = [(7, 4, 2), (14, 5, 1), (20, 7, 1), (30, 9, 1), *((n, round(n / 3.2), 1) for n in (int(45 * 1.5**i) for i in range(30)))]


#: Features of a run that are counted in passing; longer runs are cut into pieces, whose counts are added.
PIECE = 32


def _counted(rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """For runs of descending size, how many of their features have each of 64 bits, a plane for each binary digit.  All runs add their next two features at once."""
    planes = [np.zeros((rows.shape[0], size.size), np.uint64)]
    active = np.append(np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left"), 0)  # runs of more features than that
    for i in range(0, active.size - 1, 2):
        k, two = active[i], active[i + 1]
        own, a, b = planes[0][:, :k], rows[:, start[:k] + i], rows[:, start[:two] + (i + 1)]
        carry = own & a
        own ^= a
        carry[:, :two] |= own[:, :two] & b
        own[:, :two] ^= b
        if (i + 2).bit_length() > len(planes):  # the counts get a digit
            planes.append(np.zeros((rows.shape[0], size.size), np.uint64))
        for p in planes[1:-1]:
            own = p[:, :k]
            up = own & carry
            own ^= carry
            carry = up
        planes[-1][:, :k] ^= carry
    return planes


def simhash(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each non-empty run of feature hashes (one or several rows of them): a bit is set if more than half of them have it."""
    rows = np.atleast_2d(h)
    n = np.diff(off)
    out = np.zeros((rows.shape[0], n.size), np.uint64)
    short = np.flatnonzero(n <= 255)
    short = short[np.argsort((255 - n[short]).astype(np.uint8), kind="stable")]
    size, start = n[short], off[:-1][short]
    pieces = -(-size // PIECE)
    first = np.cumsum(pieces) - pieces
    begin = PIECE * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    part = np.minimum(np.repeat(size, pieces) - begin, PIECE)
    order = np.argsort((PIECE - part).astype(np.uint8), kind="stable")
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    counts = _counted(rows, (np.repeat(start, pieces) + begin)[order], part[order])
    planes = [c[:, place[first]] for c in counts]
    for k in range(1, int(pieces.max(initial=0))):
        m = int(np.searchsorted(-pieces, -k, "left"))  # runs of more pieces than that
        at = place[first[:m] + k]
        carry = np.zeros((rows.shape[0], m), np.uint64)
        if (PIECE * (k + 1)).bit_length() > len(planes):
            planes.append(np.zeros((rows.shape[0], short.size), np.uint64))
        for d, p in enumerate(planes):
            own = p[:, :m]
            if d < len(counts):
                more = counts[d][:, at]
                both = own & more
                own ^= more
                both |= own & carry
            else:
                both = own & carry
            own ^= carry
            carry = both
    more, equal = np.zeros((rows.shape[0], short.size), np.uint64), np.full(short.size, ~np.uint64(0))
    for d in range(len(planes) - 1, -1, -1):
        half = -((size >> (d + 1)) & 1).astype(np.uint64)  # the digit of half the features, for all bits
        more |= equal & planes[d] & ~half
        equal = equal & ~(planes[d] ^ half)
    out[:, short] = more
    for i in np.flatnonzero(n > 255):
        for r, raw in enumerate(rows):
            raw = np.ascontiguousarray(raw[off[i] : off[i + 1]]).view(np.uint8).reshape(-1, 8)
            total = sum(np.unpackbits(raw[x : x + 65536], axis=1).sum(axis=0, dtype=np.int64) for x in range(0, len(raw), 65536))
            out[r, i] = np.packbits(total * 2 > n[i]).view(np.uint64)[0]
    return out.reshape(*h.shape[:-1], n.size)


def _distinct(v: np.ndarray) -> np.ndarray:
    """The different values in order."""
    v = np.sort(v)
    return v[np.append(True, v[1:] != v[:-1])[: v.size]]


def _fingerprints(h: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each line, the four words of the SimHash of its distinct words, and six bytes for each of its keys: equal blocks of the schemes for its own length and for the longest line that can resemble it."""
    ends = np.concatenate([[0], np.cumsum(n_words)])
    first = np.array([x[0] for x in SCHEMES])
    blocks = np.array([x[1] for x in SCHEMES], np.uint64)
    pairs = [i for i, x in enumerate(SCHEMES) if x[2] == 2]
    sims, out, count = [], [], np.zeros(n_words.size, np.int64)
    for a in range(0, n_words.size, LINES):
        n = n_words[a : a + LINES]
        line = np.repeat(np.arange(n.size, dtype=np.uint64), n)
        own = slice(ends[a], ends[a + n.size])
        v = _distinct((line << np.uint64(46)) | (h[own] >> np.uint64(18)))  # by line, then word hash, which names the block: blocks lie together
        line, top = (v >> np.uint64(46)).astype(np.int64), (v >> np.uint64(22)) & np.uint64((1 << 24) - 1)
        word = mix(v & np.uint64((1 << 46) - 1))
        off = np.append(np.flatnonzero(np.diff(line, prepend=-1)), v.size)
        sims.append(simhash(np.stack([mix(word + np.uint64(i)) if i else word for i in range(4)]), off).T)
        own = np.searchsorted(first, n, "right") - 1
        longer = np.searchsorted(first, (n / SIMILARITY + 1e-9).astype(int), "right") - 1
        found = []
        for scheme, use in ((own, own >= 0), (longer, (longer >= 0) & (longer != own))):
            at = scheme[line]
            block = (top * blocks[at]) >> np.uint64(24)
            mine = np.flatnonzero(use[line] & (block < 2 * KEYED))
            if not mine.size:
                continue
            at, block, to = at[mine], block[mine].astype(np.int64), line[mine]
            begin = np.flatnonzero((np.diff(to, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            sim = simhash(word[mine], np.append(begin, mine.size))
            at, block, to = at[begin], block[begin], to[begin]
            key = mix(sim ^ mix((block + (at << 10) + 1).astype(np.uint64)))
            one = np.flatnonzero(~np.isin(at, pairs))
            rank = np.arange(one.size) - np.searchsorted(to[one], to[one])
            one = one[rank < KEYED]
            found.append((to[one], key[one]))
            for i in pairs:
                has, two = np.flatnonzero(use & (scheme == i)), at == i
                each = np.zeros((n.size, SCHEMES[i][1]), np.uint64)  # a block without words is whole, too
                each[to[two], block[two]] = key[two]
                found += [(has, mix(each[has, x] * np.uint64(31) + each[has, y] + np.uint64(x * 8 + y))) for x, y in combinations(range(SCHEMES[i][1]), 2)]
        to, key = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.uint64) for i in (0, 1))
        v = _distinct((to.astype(np.uint64) << np.uint64(46)) | (key >> np.uint64(18)))
        count[a : a + n.size] = np.bincount((v >> np.uint64(46)).astype(np.int64), minlength=n.size)
        out.append((v & np.uint64((1 << 46) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].ravel())
    at = np.concatenate([[0], np.cumsum(6 * count)]).astype(np.int32)
    return np.concatenate(sims), pa.Array.from_buffers(pa.binary(), n_words.size, [None, pa.py_buffer(at), pa.py_buffer(np.concatenate(out))])


def _lower(texts: list) -> list:
    return [t.lower() if isinstance(t, str) else None for t in texts]


def _lines_of(texts: list):
    """For a group of lower-cased texts: text number, line number, class hash, characters and words of every line with a word, and the hashes of the words."""
    w = Words(texts, lower=False)
    a = np.frombuffer(w.buf, np.uint8)
    nl = np.flatnonzero(a == 10)  # also ends each text
    line = np.searchsorted(nl, w.start)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    if not first.size:
        return None
    off = np.append(first, line.size)
    n_words = np.diff(off)
    rel = np.arange(line.size) - np.repeat(first, n_words)
    order = mix(rel.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    h = mix(np.add.reduceat(w.h * order, first) ^ mix(n_words.astype(np.uint64)))
    chars = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
    n_chars = np.add.reduceat(chars[w.end] - chars[w.start], first) + n_words - 1
    doc = np.searchsorted(w.doc_at, w.start[first], "right") - 1
    number = line[first] - np.searchsorted(nl, w.doc_at[doc])
    return doc, number, h, n_chars, n_words, w.h


def _lines(batches):
    """Every line of MIN_CHARS or more.  Of equal lines in a group of texts the first by (doc_id, line number) has their number and their fingerprints, the others have neither."""
    with np.errstate(over="ignore"):
        for batch in few_rows(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for x, y in groups(texts):
                found = _lines_of(_lower(texts[x:y]))
                if found is None:
                    continue
                doc, number, h, n_chars, n_words, words = found
                keep = np.flatnonzero(n_chars >= MIN_CHARS)
                if not keep.size:
                    continue
                own = ids.slice(x, y - x).to_numpy()[doc[keep]]
                order = np.lexsort((number[keep], own, h[keep]))
                begin = np.flatnonzero(np.diff(h[keep][order], prepend=~h[keep][order[:1]]))
                copies = np.zeros(keep.size, np.int64)
                copies[order[begin]] = np.diff(np.append(begin, keep.size))
                first = np.flatnonzero(copies)
                mark = np.zeros(n_words.size, bool)
                mark[keep[first]] = True
                sim, blocks = _fingerprints(words[np.repeat(mark, n_words)], n_words[mark])
                at = np.full(keep.size, -1)
                at[first] = np.arange(first.size)
                no = at < 0
                at = pa.array(at, mask=no)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(number[keep].astype(np.int32)), pa.array(h[keep].view(np.int64)), pa.array(copies, mask=no), *(pa.array(c, mask=no) for c in _spread(sim.view(np.int64).T, first, keep.size)), pa.array(n_chars[keep].astype(np.int32), mask=no), pa.array(n_words[keep].astype(np.int32), mask=no), blocks.take(at)],
                    names=["doc_id", "line_no", "h", "copies", *SIMS, "n", "words", "blocks"],
                )


def _spread(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``size`` places that hold the given values at ``at``."""
    out = np.zeros((rows.shape[0], size), rows.dtype)
    out[:, at] = rows
    return out


#: Columns of a class, at the last of its lines in order.
_CLASS = "first_doc long, first_line int, size long, sim long, sim1 long, sim2 long, sim3 long, n int, words int, blocks binary"


def _classes(batches):
    """Rows of ``_lines``, those with copies sorted by h, doc_id and line number -> every line, and at the last one of a class what the class has.  A batch's last line with copies waits for the next batch."""
    names = ["doc_id", "line_no", "h", "first_doc", "first_line", "size", *SIMS, "n", "words", "blocks"]
    last, first, before = None, None, 0
    for b in itertools.chain(batches, [None]):
        if b is not None:
            own = b.column(3).is_valid()
            more = b.filter(own)
            rest = b.filter(pc.invert(own))
            if rest.num_rows:
                none = [pa.nulls(rest.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*rest.columns[:3], *none, *rest.columns[4:]], names=names)
            b = more
            if not b.num_rows:
                continue
        elif last is None:
            return
        b = last if b is None else b if last is None else pa.concat_batches([last, b])
        final = b is last
        doc, line, h, copies = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.add.reduceat(copies, begin)
        docs, lines = doc[begin], line[begin]
        if last is not None:  # the first line here goes on with its class
            docs[:1], lines[:1] = first
            size[0] += before
        rows = h.size if final else h.size - 1
        ends = np.append(begin[1:], h.size) - 1
        mine = slice(0, ends.size if final else ends.size - 1)
        at = np.full(rows, -1)
        at[ends[mine]] = np.arange(ends.size)[mine]
        no = at < 0
        of, own = pa.array(at, mask=no), pa.array(np.arange(rows), mask=no)
        yield pa.RecordBatch.from_arrays([*(b.column(i).slice(0, rows) for i in range(3)), *(pa.array(c).take(of) for c in (docs, lines, size)), *(b.column(i).take(own) for i in range(4, b.num_columns))], names=names)
        last, first, before = b.slice(b.num_rows - 1), (docs[-1], lines[-1]), size[-1] - copies[-1]


#: A class under one of its keys.
MEMBER = np.dtype([("key", "<i8"), ("h", "<i8"), ("sim", "<i8"), ("n", "<i4")])
#: Keys that leave a task at once, and members of a range of keys that may wait for the others of it.
AT_ONCE, WAITING = 1 << 18, 1 << 22


def _keys(bits: int):
    """The classes under each of their keys, a row for those of a range of keys; ``bits`` of a key name its range."""

    def run(batches):
        parts, many = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                h, sim, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                blocks = b.column(3).to_pylist()
                row = np.repeat(np.arange(h.size), [len(g) // 6 for g in blocks])
                key = np.zeros((row.size, 8), np.uint8)
                key[:, :6] = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 6)
                m = np.empty(row.size, MEMBER)
                m["key"], m["h"], m["sim"], m["n"] = key.view(np.int64)[:, 0], h[row], sim[row], n[row]
                parts.append(m)
                many += m.size
            if many and (b is None or many >= AT_ONCE):
                m = np.concatenate(parts)
                part = m["key"] >> (46 - bits)
                order = np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")
                part = part[order]
                begin = np.flatnonzero(np.diff(part, prepend=-1))
                at = (np.append(begin, m.size) * MEMBER.itemsize).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.Array.from_buffers(pa.binary(), begin.size, [None, pa.py_buffer(at), pa.py_buffer(m[order])])], names=["part", "members"])
                parts, many = [], 0

    return run


def _in_order(batches):
    """Rows of ``_keys`` sorted by range -> members sorted by key, those of a key by their SimHash, so that most of what is near meets in passing.  Members of a range wait for the others; if they are too many, those of crowded keys go on, but for some that show what comes after them that its key is crowded, too."""
    held, part = np.empty(0, MEMBER), None
    for b in itertools.chain((b for b in batches if b.num_rows), [None]):
        if b is None:
            now, held = held, held[:0]
        else:
            parts, blobs = b.column(0).to_numpy(), b.column(1)
            at = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + parts.size + 1]
            m = np.frombuffer(blobs.buffers()[2], MEMBER, (at[-1] - at[0]) // MEMBER.itemsize, at[0])
            split = (at[np.searchsorted(parts, parts[-1])] - at[0]) // MEMBER.itemsize  # where the last range begins
            if part == parts[-1]:
                now, held = held[:0], np.concatenate([held, m])
            else:
                now, held = np.concatenate([held, m[:split]]), m[split:].copy()
            part = parts[-1]
        waiting = []
        if held.size > WAITING:
            _, of, size = np.unique(held["key"], return_inverse=True, return_counts=True)
            order = np.argsort(of, kind="stable")
            place = np.empty(held.size, np.int64)
            place[order] = np.arange(held.size) - np.repeat(np.cumsum(size) - size, size)
            crowded = size[of] > 2 * WINDOW
            waiting, held = [held[crowded]], held[~crowded | (place <= 2 * WINDOW)]
        for m in (now, *waiting):
            by = (m["key"].astype(np.uint64) << np.uint64(18)) | (m["sim"].view(np.uint64) >> np.uint64(46))
            order = np.argsort(by)
            same = np.diff(by[order] >> np.uint64(18), prepend=~np.uint64(0), append=~np.uint64(0)) == 0
            m = m[order[same[1:] | same[:-1]]]  # most keys have one member, which meets none
            if m.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m[c])) for c in MEMBER.names], names=list(MEMBER.names))


def _met(batches):
    return _compare(_in_order(batches))


def _compare(batches):
    """Rows sorted by key -> candidate pairs; members of keys with more than WINDOW come back as hot.

    A pair is reported under every key that it shares.  A key's rows may span
    batches: its first row and its last WINDOW rows are carried on.
    """
    carry = None
    for b in batches:
        key, h, sim, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        sim = sim.view(np.uint64)
        old = 0
        if carry is not None and key.size and carry["key"] == key[0]:
            old = carry["h"].size
            h, sim, n = np.concatenate([carry["h"], h]), np.concatenate([carry["sim"], sim]), np.concatenate([carry["n"], n])
            key = np.concatenate([np.full(old, carry["key"], key.dtype), key])
        if not key.size:
            continue
        first = np.flatnonzero(np.diff(key, prepend=~key[0]))
        run = np.repeat(np.arange(first.size), np.diff(np.append(first, key.size)))
        place = np.arange(key.size) - first[run]
        seen = carry["seen"] if old else 0
        ia, ib = [], []
        for d in range(1, WINDOW + 1):
            i = np.flatnonzero(run[d:] == run[:-d])
            if not i.size:
                break
            i = i[i + d >= old]
            ia.append(i)
            ib.append(i + d)
        # beyond the window: with the pivot, the first row of the key
        total = place + np.where(run == 0, seen - old if old else 0, 0)
        far = np.flatnonzero(total > WINDOW)
        far = far[far >= old]
        a = np.concatenate([h[i] for i in ia]) if ia else h[:0]
        bb = np.concatenate([h[i] for i in ib]) if ib else h[:0]
        sa = np.concatenate([sim[i] for i in ia]) if ia else sim[:0]
        sb = np.concatenate([sim[i] for i in ib]) if ib else sim[:0]
        na = np.concatenate([n[i] for i in ia]) if ia else n[:0]
        nb = np.concatenate([n[i] for i in ib]) if ib else n[:0]
        if far.size:
            ph, ps, pn = h[first][run[far]], sim[first][run[far]], n[first][run[far]]
            if old:
                mine = run[far] == 0
                ph, ps, pn = np.where(mine, carry["ph"], ph), np.where(mine, np.uint64(carry["ps"]), ps), np.where(mine, carry["pn"], pn)
            a, bb, sa, sb, na, nb = (np.concatenate(p) for p in ((a, ph), (bb, h[far]), (sa, ps), (sb, sim[far]), (na, pn), (nb, n[far])))
        ok = (np.bitwise_count(sa ^ sb) <= RADIUS) & (np.minimum(na, nb) >= SIMILARITY * np.maximum(na, nb) - 1e-9)
        yield _out(np.minimum(a, bb)[ok], np.maximum(a, bb)[ok], None)
        # members of hot keys, for what the window has not compared
        hot_run = np.zeros(first.size, bool)
        hot_run[run[far]] = True
        hot = np.flatnonzero(hot_run[run])
        if old and hot_run[0] and seen <= WINDOW + 1:
            pass  # carried rows of a key that has only now become hot are among the first rows here
        elif old and hot_run[0]:
            hot = hot[hot >= old]
        if hot.size:
            yield _out(h[hot], None, key[hot])
        # carry the last key on
        at = int(first[-1])
        same = old > 0 and first.size == 1
        carry = {
            "key": key[-1], "h": h[max(at, key.size - WINDOW - 1) :], "sim": sim[max(at, key.size - WINDOW - 1) :], "n": n[max(at, key.size - WINDOW - 1) :],
            "ph": carry["ph"] if same else h[at], "ps": carry["ps"] if same else sim[at], "pn": carry["pn"] if same else n[at],
            "seen": (seen - old if same else 0) + key.size - at,
        }


_OUT = "a long, b long, key long"


def _out(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(cols[0].size, pa.int64()) if c is None else pa.array(c) for c in cols], names=["a", "b", "key"])


def bits_apart(n: np.ndarray) -> np.ndarray:
    """Bits of 256 in which two lines, the longer of n words, differ after the most edits allowed: the mean and 1.3 deviations."""
    share = np.arccos(1 - np.floor((1 - SIMILARITY) * n + 1e-9) / n) / np.pi
    return 256 * share + 1.3 * 16 * np.sqrt(share * (1 - share))


#: No length allows more.
_MOST_APART = float(bits_apart(np.arange(7, 20_000)).max())


def _close(apart, i, j, h, label, n, sims) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j) of members of different labels, ``apart`` in the first three words, those whose lengths and SimHashes of 256 bits allow a link."""
    apart = apart + np.bitwise_count(sims[3][i] ^ sims[3][j])
    long = np.maximum(n[i], n[j])
    ok = (apart <= bits_apart(long)) & (np.minimum(n[i], n[j]) >= SIMILARITY * long - 1e-9)
    return i[ok], j[ok]


def _near(h, label, n, sims, split: int) -> np.ndarray:
    """(2, pairs), places of members: of the members before ``split`` with those from it on (or with each other, if none come after) the pairs of different labels whose lengths and SimHashes of 256 bits allow a link; a strip of rows at a time, and only with those of like lengths."""
    alone = split == h.size  # a block with itself
    out = [np.empty((2, 0), np.int64)]
    if (label == label[:1]).all():
        return out[0]
    mine = np.argsort(n[:split], kind="stable")
    others = mine if alone else split + np.argsort(n[split:], kind="stable")
    size, theirs = n[others], [s[others] for s in sims[:3]]
    differ, count, more = np.empty(STRIP, np.uint64), np.empty(STRIP, np.uint8), np.empty(STRIP, np.uint8)
    x = 0
    while x < split:
        shortest = n[mine[x]]
        first = int(np.searchsorted(size, SIMILARITY * shortest - 1e-6))
        strip = max(1, min(STRIP // max(1, others.size - first), split - x))
        rows = mine[x : x + strip]
        last = int(np.searchsorted(size, n[rows[-1]] / SIMILARITY + 1e-6, "right"))
        first = max(first, x + 1 if alone else 0)  # those before have met these rows
        wide = max(0, last - first)
        if wide:
            parts = [b[: rows.size * wide] for b in (differ, count, more)] if rows.size * wide <= STRIP else [np.empty(rows.size * wide, t) for t in (np.uint64, np.uint8, np.uint8)]
            table, apart, again = (p.reshape(rows.size, wide) for p in parts)
            for c in range(3):
                np.bitwise_count(np.bitwise_xor(sims[c][rows, None], theirs[c][None, first:last], out=table), out=again if c else apart)
                if c:
                    apart += again
            at = np.flatnonzero(parts[1] <= _MOST_APART)  # three quarters of the bits leave few
            i, j = at // wide, at % wide + first
            if alone:
                at, i, j = (c[j > i + x] for c in (at, i, j))
            i, j = rows[i], others[j]
            ok = label[i] != label[j]
            out.append(np.stack(_close(parts[1][at[ok]].astype(np.int64), i[ok], j[ok], h, label, n, sims)))
        x += strip
    return np.concatenate(out, axis=1)


def _near_in_small(h, label, n, sims, size: np.ndarray) -> np.ndarray:
    """The same of many small groups, one behind the other, each of ``size`` members that meet each other: members d places apart, for all groups at once, the larger groups first."""
    order = np.argsort(-size, kind="stable")
    many = size[order]
    ends = np.cumsum(many)
    at = np.repeat((np.cumsum(size) - size)[order] - (ends - many), many) + np.arange(h.size)
    group = np.repeat(np.arange(size.size), many)
    own = [s[at] for s in sims[:3]]
    out = [np.empty((2, 0), np.int64)]
    for d in range(1, int(size.max(initial=0))):
        m = ends[np.searchsorted(-many, -d, "left") - 1]  # members of groups of more than d
        apart = sum(np.bitwise_count(s[: m - d] ^ s[d:m]) for s in own)
        i = np.flatnonzero(apart <= _MOST_APART)
        i = i[group[i] == group[i + d]]
        apart, i, j = apart[i], at[i], at[i + d]
        ok = label[i] != label[j]
        out.append(np.stack(_close(apart[ok].astype(np.int64), i[ok], j[ok], h, label, n, sims)))
    return np.concatenate(out, axis=1)


def _undecided(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of members may be similar by 16 bits of each word's hash; equal bits of different words only bring lines nearer.  Members without words may."""
    out = np.ones(i.size, bool)
    has = np.array([w is not None for w in words], bool)
    own = np.flatnonzero(has[i] & has[j])
    at, place = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
    lists = [np.frombuffer(words[k], np.uint16) for k in at]
    for x in range(0, own.size, DECIDED):
        part = own[x : x + DECIDED]
        a, b = place[x : x + part.size], place[own.size + x : own.size + x + part.size]
        out[part] = _similar([lists[k] for k in a], [lists[k] for k in b])
    return out


def _block_pairs(batches):
    """Rows sorted by key, i, j and side -> the pairs of each group that fingerprints and short words (the last column, if there is one) leave.  A group whose end has not come yet is carried on."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is None:
            if held is None:
                return
            cols, ends = held, [held[0].size]
        else:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            ends = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1).tolist()
        ends = np.array(ends, np.int64)
        size = np.diff(ends, prepend=0)
        begin, found = int(ends[-1]) if ends.size else 0, [np.empty((2, 0), np.int64)]
        small = (size <= FEW) & (cols[1][ends - 1] == cols[2][ends - 1])
        for one in [None, *np.flatnonzero(~small).tolist()]:
            rows = np.flatnonzero(small.repeat(size)) if one is None else slice(int(ends[one] - size[one]), int(ends[one]))
            side, h, label, n, *more = (c[rows] for c in cols[3:])
            n, sims = n.astype(np.int64), [s.view(np.uint64) for s in more[: len(SIMS)]]
            i, j = _near_in_small(h, label, n, sims, size[small]) if one is None else _near(h, label, n, sims, int(np.searchsorted(side, 1)))
            for words in more[len(SIMS) :]:
                ok = _undecided(words, i, j)
                i, j = i[ok], j[ok]
            found.append(np.stack([np.minimum(h[i], h[j]), np.maximum(h[i], h[j])]))
        held = [c[begin:] for c in cols]
        x, y = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _block_members(batches):
    """The members of the pairs that ``_block_pairs`` leaves."""
    for b in _block_pairs(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_distinct(np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()])))], names=["h"])


def _dealt(members: DataFrame, more: list[str]) -> DataFrame:
    """Rows of groups, each a pair of blocks of a key, in the order that ``_block_pairs`` takes."""
    m = members.withColumn("blk", F.pmod(F.xxhash64("h", "key"), F.col("nb"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    m = m.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), (F.col("blk") > F.col("other")).cast("int").alias("side"), "h", "label", "n", *SIMS, *more)
    return m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")


def _in_blocks(hot: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between hot keys' members that no link joins yet; keys of one group end here.

    Members are dealt into blocks of about BLOCK, and every pair of blocks of a
    key is a group of its own, so a group's size is bounded whatever the key's.
    Members meet by their SimHashes alone first; those that these leave in a pair
    fetch their words and meet again, so what leaves a group the first time is
    members, and the second time links (and pairs of very long lines).
    """
    marked = classes.select("h", F.col("words").alias("n"), *SIMS).join(found.select(F.col("id").alias("h"), F.col("component").alias("label")), "h", "left")
    members = written(hot.join(marked, "h").select("key", "h", F.coalesce("label", "h").alias("label"), "n", *SIMS), "members")
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("nb"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key", "nb")
    sizes = written(sizes, "sizes")
    few = small_enough(sizes)
    sized = F.broadcast(sizes) if few else sizes
    some = written(_dealt(members.join(sized, "key"), []).mapInArrow(_block_members, "h long").distinct(), "some")
    words = _words_of(some, classes, docs)
    near = written(_dealt(only(members, some, "h").join(words.select("h", "short"), "h").join(sized, "key"), ["short"]).mapInArrow(_block_pairs, "a long, b long").distinct(), "near")
    for table in (members, sizes, some):
        dropped(table)
    links = _verified(near, words)
    dropped(near)
    dropped(words)
    return links


def _joined_groups(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found``, (id, component), after more links: only the groups that these join are gone through again."""
    ends = [found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    between = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(between)
    new = top.select("id").join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.union(new).join(top.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def _two_ways(words: list[np.ndarray]) -> list[pa.Array]:
    """Lines' words as 32 bits of each hash, and as 16 for lines of up to SHORT words."""
    off = np.concatenate([[0], np.cumsum([w.size for w in words])]).astype(np.int32)
    flat = np.concatenate([*words, np.empty(0, np.uint64)])
    return [pa.ListArray.from_arrays(pa.array(off), pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32))), pa.array([(w >> np.uint64(48)).astype(np.uint16).tobytes() if w.size <= SHORT else None for w in words], pa.binary())]


def _line_words(batches):
    """h and the words of every line, two ways."""
    with np.errstate(over="ignore"):
        for batch in few_rows(batches):
            ids, texts = batch.column(0), _lower(batch.column(1).to_pylist())
            for x, y in groups(texts):
                found = _lines_of(texts[x:y])
                if found is None:
                    continue
                doc, number, h, _, n_words, words = found
                lists = _two_ways(np.split(words, np.cumsum(n_words)[:-1]))
                yield pa.RecordBatch.from_arrays([ids.slice(x, y - x).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(h.view(np.int64)), *lists], names=["doc_id", "line_no", "h", "words", "short"])


def _wanted_words(batches):
    """h and the words, two ways, of the lines in ``wanted``, (line number, h) of a document; no other line is looked at."""
    with np.errstate(over="ignore"):
        for batch in few_rows(batches):
            texts, wanted = batch.column(1).to_pylist(), batch.column(2)
            asked = np.concatenate([[0], np.cumsum(np.asarray(wanted.value_lengths()))])
            numbers, keys = (wanted.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("line_no", "h"))
            lines, key = [], []
            for t, a, b in zip(texts, asked, asked[1:], strict=False):
                own = t.lower().split("\n") if isinstance(t, str) else []
                for i, k in zip(numbers[a:b].tolist(), keys[a:b].tolist(), strict=True):
                    if i < len(own):
                        lines.append(own[i])
                        key.append(k)
            for x, y in groups(lines):
                found = _lines_of(lines[x:y])
                if found is None:
                    continue
                line, _, h, _, n_words, words = found
                off = np.concatenate([[0], np.cumsum(n_words)])
                same = np.flatnonzero(h.view(np.int64) == np.array(key[x:y], np.int64)[line])  # of several texts under one doc_id, the one that has the line
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[same]), *_two_ways([words[off[k] : off[k + 1]] for k in same])], names=["h", "words", "short"])


def _few_edits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two long lines differ by no more edits than allowed: furthest-reaching diagonals, so the cost follows the edits."""
    k, n, m = most_edits(max(a.size, b.size)), a.size, b.size
    if abs(n - m) > k:
        return False
    apart: dict[int, np.ndarray] = {}

    def slide(d: int, i: int) -> int:
        """From a[i], b[i + d]: the first i at which they differ."""
        if d not in apart:
            lo, hi = max(0, -d), min(n, m - d)
            apart[d] = np.append(np.flatnonzero(a[lo:hi] != b[lo + d : hi + d]) + lo, hi)
        at = apart[d]
        return int(at[np.searchsorted(at, i)]) if i < at[-1] else i

    reach = {0: slide(0, 0)}
    for e in range(k + 1):
        if reach.get(m - n, -1) >= n:
            return True
        new = {}
        for d in range(max(-n, -e - 1), min(m, e + 1) + 1):
            i = max(reach.get(d, -9) + 1, reach.get(d + 1, -9) + 1, reach.get(d - 1, -9))
            if i < 0 or i < -d:
                continue
            i = min(i, n, m - d)
            new[d] = slide(d, i)
        reach = new
    return False


def _parts(own: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """``own`` in runs of about a million words."""
    return [p for p in np.split(own, np.flatnonzero(np.diff(np.cumsum(size[own]) >> 20)) + 1) if p.size]


def _lacking(pa_: np.ndarray, x: np.ndarray, pb: np.ndarray, y: np.ndarray, pairs: int) -> np.ndarray:
    """For each pair of lines, the words (counted as often as they come) that one line lacks of the other, the more of both ways: no fewer edits do.  Words are told apart by 32 bits."""
    low = np.int64(0xFFFFFFFF)
    v = np.sort(np.concatenate([(pa_ << 33) | ((x & low) << 1), (pb << 33) | ((y & low) << 1) | 1]))
    if not v.size:
        return np.zeros(pairs)
    first = np.flatnonzero(np.diff(v >> 1, prepend=-1))
    count = np.add.reduceat(1 - 2 * (v & 1), first)
    of = v[first] >> 33
    return np.maximum(np.bincount(of, np.maximum(count, 0), pairs), np.bincount(of, np.maximum(-count, 0), pairs))


def _similar(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of lines: whether their edit similarity suffices.  Places that differ and words that one line lacks decide most; the others by banded tables of many pairs at once, long lines one by one."""
    n, m = np.array([x.size for x in a], np.int64), np.array([x.size for x in b], np.int64)
    long = np.maximum(n, m)
    most = ((1 - SIMILARITY) * long + 1e-9).astype(int)
    ok = np.abs(n - m) <= most
    open_ = np.zeros(ok.size, bool)
    for part in _parts(np.flatnonzero(ok), n + m):
        x, y = (np.concatenate([v[i] for i in part]).astype(np.int64) for v in (a, b))
        pair = np.arange(part.size)
        same = n[part] == m[part]
        xs, ys = x[np.repeat(same, n[part])], y[np.repeat(same, m[part])]
        apart = np.full(part.size, 1 << 40)
        apart[same] = np.bincount(np.repeat(pair[same], n[part][same]), xs != ys, part.size)[same]
        left = apart > most[part]  # those that differ in few places are similar
        xl, yl = x[np.repeat(left, n[part])], y[np.repeat(left, m[part])]
        lacks = _lacking(np.repeat(pair[left], n[part][left]), xl, np.repeat(pair[left], m[part][left]), yl, part.size)
        ok[part] = ~left | (lacks <= most[part])
        open_[part] = left & (lacks <= most[part])
    for i in np.flatnonzero(open_ & (long > TABLED)):
        ok[i] = _few_edits(a[i], b[i])
    own = np.flatnonzero(open_ & (long <= TABLED))
    own = own[np.argsort(long[own], kind="stable")]
    for run in _alike_sizes(long[own]):
        part = own[run]
        ok[part] = _banded([a[i] for i in part], [b[i] for i in part], most[part])
    return ok


def _alike_sizes(size: np.ndarray) -> list[slice]:
    """Runs of an ascending array: each of few pairs and of sizes that are not far apart, so that a table fits them all."""
    out, a = [], 0
    while a < size.size:
        b = int(np.searchsorted(size, 1.25 * size[a] + 4, "right"))
        b = min(b, a + max(1, min(TABLES, (1 << 20) // int(size[b - 1]))))
        out.append(slice(a, b))
        a = b
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether pairs differ by at most ``most`` edits.  Pairs are columns, cells are rows: a step is a few operations on long runs.

    A path off the diagonals between the first and the last costs two edits a step, so
    the band is about as wide as ``most``.  Cell c of step i holds the distance of
    a[:i] and b[:i + c - low], less c, so an inserted word is a plain minimum.
    Pairs that can't end in time are left out on the way.
    """
    a, b = [u if u.size <= v.size else v for u, v in zip(a, b, strict=True)], [v if u.size <= v.size else u for u, v in zip(a, b, strict=True)]
    n, m = np.array([x.size for x in a]), np.array([x.size for x in b])
    most, more = np.asarray(most), m - n
    out = np.zeros(n.size, bool)
    pairs = np.flatnonzero(more <= most)
    if not pairs.size:
        return out
    low, high = int(((most - more)[pairs] // 2).max()), int(((most + more)[pairs] // 2).max())
    rows, width = int(n[pairs].max()), low + high + 1
    x, y = np.zeros((rows, pairs.size), np.int32), np.zeros((max(rows + width, low + int(m[pairs].max())), pairs.size), np.int32)  # y: b, shifted by low; what is beyond the ends decides nothing
    for at, i in enumerate(pairs):
        x[: n[i], at] = a[i]
        y[low : low + m[i], at] = b[i]
    far = 1 << 14
    c = np.arange(width)[:, None]
    row = np.where(c >= low, -low, far).astype(np.int16).repeat(pairs.size, 1)
    own = n[pairs]
    for i in range(rows + 1):
        end = np.flatnonzero(own == i)
        if end.size:
            at = more[pairs[end]] + low
            out[pairs[end]] = row[at, end] + at <= most[pairs[end]]
        if i == rows:
            break
        if i % 16 == 15:
            stay = own > i
            stay &= (row + c + np.abs(c - low - more[pairs])).min(axis=0) <= most[pairs]
            if not stay.any():
                break
            if 4 * stay.sum() <= 3 * stay.size:
                pairs, own, x, y, row = pairs[stay], own[stay], x[:, stay], y[:, stay], row[:, stay]
        new = row + (x[i] != y[i : i + width])
        np.minimum(new[:-1], row[1:] + np.int16(2), out=new[:-1])
        if i < low:
            new[: low - i - 1] = far
            new[low - i - 1] = 2 * (i + 1) - low
        if pairs.size < 64:
            np.minimum.accumulate(new, axis=0, out=new)
        else:
            for z in range(1, width):
                np.minimum(new[z], new[z - 1], out=new[z])
        row = new
    return out


def _alike(batches):
    for batch in batches:
        a, b = (np.split(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(batch.column(c).value_lengths()))[:-1]) for c in ("wa", "wb"))
        ok = pa.array(_similar(a, b)) if batch.num_rows else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])


def _words_of(used: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """h and the words of the classes in ``used``, from the documents that hold their first occurrence, written."""
    where = written(classes.join(used, "h", "left_semi").select("h", F.col("first_doc").alias("doc_id"), F.col("first_line").alias("line_no")), "used")
    few = small_enough(where, BROADCAST_LINES)
    if few:  # each document gets the numbers of its lines, so that no other line leaves it
        lists = where.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h")).alias("wanted"))
        some = docs.select("doc_id", "text").join(F.broadcast(lists), "doc_id")
        return _once(written(some.mapInArrow(_wanted_words, "h long, words array<int>, short binary"), "words"), where)
    some = only(docs, where.select("doc_id").distinct(), "doc_id").select("doc_id", "text")
    lines = some.mapInArrow(_line_words, "doc_id long, line_no int, h long, words array<int>, short binary")
    return _once(written(lines.join(where, ["doc_id", "line_no", "h"], "left_semi").select("h", "words", "short"), "words"), where)


def _once(words: DataFrame, where: DataFrame) -> DataFrame:
    """A written table of words with each h of ``where`` once: there are more rows only if documents are repeated."""
    if words.count() <= where.count():
        return words
    one = written(words.dropDuplicates(["h"]), "words")
    dropped(words)
    return one


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, of class hashes whose lines, in a written table of words, are similar enough."""
    a = lines.select(F.col("h").alias("a"), F.col("words").alias("wa"))
    b = lines.select(F.col("h").alias("b"), F.col("words").alias("wb"))
    parts = max(1, -(-pairs.count() // PAIRS))
    links = None
    for i in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i) if parts > 1 else pairs
        part = written(some.join(a, "a").join(b, "b").select("a", "b", "wa", "wb").mapInArrow(_alike, "a long, b long"), "links")
        links = part if links is None else links.union(part)
    return links


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, removed): for every document with a line to remove, its lines that take part and the numbers (from 0) of those that go."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # what later steps don't need goes as soon as the step before is written
    found = docs.mapInArrow(_lines, "doc_id long, line_no int, h long, copies long, sim long, sim1 long, sim2 long, sim3 long, n int, words int, blocks binary")
    dealt = F.when(F.col("copies").isNull(), F.xxhash64("doc_id", "line_no")).otherwise(F.col("h"))  # copies that a group has counted are dealt anywhere, so a common line crowds no task
    full = written(found.repartition(dealt).sortWithinPartitions("h", "doc_id", "line_no").mapInArrow(_classes, f"doc_id long, line_no int, h long, {_CLASS}"), "lines")
    lines, classes = full.select("doc_id", "line_no", "h"), full.where("size is not null").drop("doc_id", "line_no")
    keyed = classes.where(F.length("blocks") > 0).select("h", "sim", F.col("words").alias("n"), "blocks")
    bits = min(30, max(12, (full.count() // (AT_ONCE // 12)).bit_length()))
    # n is the number of words from here on
    met = written(keyed.mapInArrow(_keys(bits), "part long, members binary").repartition("part").sortWithinPartitions("part").mapInArrow(_met, _OUT), "met")
    pairs = written(met.where("b is not null").select("a", "b").distinct(), "near")
    hot = met.where("b is null").select(F.col("a").alias("h"), "key")  # a member comes once under a key
    words = _words_of(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), classes, docs)
    found = components(_verified(pairs, words))
    dropped(pairs)
    dropped(words)
    if not hot.isEmpty():
        more = _in_blocks(hot, found, classes, docs)
        if not more.isEmpty():
            found = written(_joined_groups(found, more), "found")
    dropped(met)
    group = classes.select("h", F.struct(F.col("first_doc").alias("doc_id"), F.col("first_line").alias("line_no")).alias("first"), "size").join(found.select(F.col("id").alias("h"), "component"), "h", "left").where("component is not null or size > 1").withColumn("group", F.coalesce("component", "h"))
    group = written(group.select("h", "first", "size", "group"), "group")
    keep = group.groupBy("group").agg(F.min("first").alias("keep"), F.sum("size").alias("size")).where("size > 1")
    gone = group.join(keep.select("group", "keep"), "group").select("h", "keep")
    out = lines.join(gone, "h").where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("line_no") != F.col("keep.line_no")))
    return out.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def _without(emptied: bool):
    """Texts without their removed lines; the lines to remove are the last column.  Unless ``emptied``, rows that lose their last word go."""

    def run(batches):
        for b in few_rows(batches):
            names = b.schema.names[:-1]
            texts, removed = b.column(names.index("text")).to_pylist(), b.column(len(names)).to_pylist()
            stay = [True] * len(texts)
            for i, gone in enumerate(removed):
                if gone and texts[i] is not None:
                    gone = set(gone)
                    texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in gone)
                    stay[i] = emptied or bool(texts[i].strip("\x20\t\n\v\f\r"))
            out = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(i) for i, n in enumerate(names)], names=names)
            yield out if all(stay) else out.filter(pa.array(stay))

    return run


def _joined(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the lines to remove as last column, and that column's name, which no other column has."""
    own = unused("removed", docs)
    gone = written(gone.select(F.col("doc_id").alias(f"{own}_id"), F.col("removed").alias(own)), "removals")
    few = small_enough(gone, 200_000) and (gone.agg(F.sum(F.size(own))).first()[0] or 0) <= 2_000_000
    right = F.broadcast(gone) if few else gone
    return docs.join(right, docs["doc_id"] == right[f"{own}_id"], "left").drop(f"{own}_id"), own


def deduplicate(docs: DataFrame, emptied: bool = True) -> DataFrame:
    """``docs`` with every repeated line removed from ``text``; ``n_chars`` follows the text where it exists.

    Documents all of whose lines occur elsewhere (copies of others) stay with what
    is left of them, nothing, unless ``emptied`` is false; texts that had no word stay.
    """
    d, _ = _joined(docs, removals(docs))
    out = d.mapInArrow(_without(emptied), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed for every document."""
    d, own = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines")), removals(docs))
    return d.select("doc_id", "n_lines", F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(own, F.array().cast("array<int>")).alias("removed"))
