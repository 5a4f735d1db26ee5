import random
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import DATA

from tessera.llm import linededup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    """Removed line numbers by comparing all pairs of lines."""
    where = {}
    for i, t in sorted(rows):
        for j, line in enumerate((t or "").lower().split("\n")):
            n = " ".join(line.translate(str.maketrans("\t\v\f\r", "    ")).split(" "))
            n = " ".join(x for x in n.split(" ") if x)
            if len(n) >= L.MIN_CHARS:
                where.setdefault(n, []).append((i, j))
    lines = list(where)
    up = {x: x for x in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    words = sorted((x.split(" ") for x in lines), key=len)
    for a, x in enumerate(words):
        for y in words[a + 1 :]:
            most = L.most_edits(len(y))
            if len(y) - len(x) > most:
                break
            if sum((Counter(y) - Counter(x)).values()) <= most and distance(x, y) <= most:  # each word missing from x is an edit
                up[find(" ".join(x))] = find(" ".join(y))
    groups = {}
    for x in lines:
        groups.setdefault(find(x), []).extend(where[x])
    gone = {}
    for places in groups.values():
        for i, j in sorted(places)[1:]:
            gone.setdefault(i, set()).add(j)
    return {i: sorted(v) for i, v in gone.items()}


def test_documents_equal_brute_force(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.removed for r in L.report(d).collect() if r.removed}
    assert got == brute([tuple(r) for r in d.collect()])


def test_many_variants_of_a_line(spark):
    rng = random.Random(5)
    base = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"other{rng.randrange(1000)}"
        rows.append((i, f"Head {i}\n" + " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in L.report(d).collect() if r.removed}
    assert got == brute(rows) and len(got) > 20


def test_odd_rows_and_columns(spark):
    rows = [(1, "one two three four\nshort\n\nshort", "a", 9), (2, "ONE  two three four", "b", None), (3, None, None, 1), (4, "", "x", 0), (None, "one two three four", "n", 2), (5, "y " * 60_000, "long", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, removed string, n_chars int")
    got = L.deduplicate(d)
    assert got.columns == d.columns and got.count() == 6
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[1] == rows[0][1] and text[2] == "" and text[3] is None and text[4] == "" and text[None] == "one two three four"
    clash = L.deduplicate(d.withColumnsRenamed({"removed": "_removed", "n_chars": "removed_id"}))
    assert clash.columns == ["doc_id", "text", "_removed", "removed_id"] and {r[0]: r[2] for r in clash.collect()} == {r[0]: r[2] for r in rows}
    assert L.deduplicate(d.where("false")).count() == 0
    fewer = L.deduplicate(d, emptied=False)
    assert {r.doc_id for r in fewer.collect()} == {1, 3, 4, None, 5}  # 2 was a copy; 3 and 4 had no word before
    twice = L.deduplicate(d.where("doc_id = 1").union(d.where("doc_id = 1"))).collect()
    assert [r.text for r in twice] == [rows[0][1]] * 2


def test_similarity_against_the_full_table():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 9) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            q = rng.randint(0, len(b))
            b[q : q + rng.randint(0, 1)] = [rng.randint(0, 9)] * rng.randint(0, 1)
        if b:
            want = distance(a, b) <= L.most_edits(max(len(a), len(b)))
            x, y = np.array(a), np.array(b)
            assert bool(L._similar([x], [y])[0]) == want and L._few_edits(x, y) == want


def test_compare_over_batches():
    """Keys that span batches: window pairs and pivot pairs are the same however the rows are cut."""
    rng = np.random.default_rng(4)
    n = 400
    key = np.sort(rng.integers(0, 6, n))
    h, sim = np.arange(n), np.zeros(n, np.int64)

    def run(cuts):
        rows = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(h[a:b]), pa.array(sim[a:b]), pa.array(np.full(b - a, 9, np.int32)), pa.array(np.zeros(b - a, np.int8))], names=list("khsnx")) for a, b in zip(cuts, cuts[1:], strict=False)]
        out = pa.Table.from_batches(list(L._compare(iter(rows)))).to_pandas()
        pairs = out[out.b.notna()]
        return set(zip(pairs.a, pairs.b.astype(int), strict=True)), sorted(out[out.b.isna()].a)

    whole = run([0, n])
    assert whole == run([0, 3, 7, 100, 101, 250, n]) == run(list(range(n + 1)))
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and (j - i <= L.WINDOW or i == np.searchsorted(key, key[i]))}
    assert whole[0] == want and whole[1] == list(range(n))


def test_lines_within_the_similarity_are_found(spark):
    """Lines with as many random edits as SIMILARITY allows; the measure is the edit distance alone."""
    rng = random.Random(8)
    rows, found = [], {}
    for n in (7, 8, 10, 13, 14, 15, 19, 20, 26, 27, 40, 60, 100, 200):
        for _ in range(40):
            a = [f"w{rng.randrange(3000)}x" for _ in range(n)]
            b = list(a)
            for _ in range(L.most_edits(n)):
                b[rng.randrange(n)] = f"w{rng.randrange(3000)}x"
            if n in (7, 14):
                b = a[: n - 1] if n == 7 else a[1 : n - 1]  # one shorter: six words against seven, twelve against fourteen
            if n in (19, 27, 60) and rng.random() < 0.5:
                del b[rng.randrange(n)]
                b.insert(rng.randrange(n - 1), a[0])
            if a != b and distance(a, b) <= L.most_edits(n):
                i = len(rows)
                rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
                found[i + 1] = n
    rows += [(10_000 + i, " ".join(f"w{rng.randrange(3000)}x" for _ in range(30))) for i in range(300)]  # like no other
    gone = {r.doc_id for r in L.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.removed}
    assert gone <= set(found)
    by_n = {n: [i in gone for i, m in found.items() if m == n] for n in set(found.values())}
    assert all(sum(v) >= 0.95 * len(v) for v in by_n.values()), {n: sum(v) / len(v) for n, v in by_n.items()}


def test_lines_of_short_words_and_other_scripts_are_found(spark):
    """The same for words of one to four letters, two bytes a letter, or from a small vocabulary."""
    rng = random.Random(3)
    kinds = {
        "short": [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("", *"aeiou", "an", "is", "or")],
        "cyrillic": [f"{a}{b}{c}" for a in "бвгдклмнпрст" for b in "аеио" for c in ("", *"бкмнт")],
    }
    rows, found = [], {}
    for kind, words in kinds.items():
        for n in (20, 25, 29, 30, 44, 45, 70, 100):
            for _ in range(40):
                a = [rng.choice(words) for _ in range(n)]
                b = list(a)
                for _ in range(rng.choice((1, L.most_edits(n)))):
                    b[rng.randrange(n)] = rng.choice(words)
                if a != b:
                    i = len(rows)
                    rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
                    found[i + 1] = kind
    rows += [(10_000 + i, " ".join(["na"] * (30 + i) + [f"x{i}"])) for i in range(4)]  # one repeated word
    gone = {r.doc_id for r in L.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.removed}
    assert gone - set(found) == {10_001, 10_002, 10_003}
    for kind in kinds:
        hits = [i in gone for i, k in found.items() if k == kind]
        assert sum(hits) >= 0.95 * len(hits), (kind, sum(hits) / len(hits))


def test_words_come_alike_with_and_without_broadcast(spark, monkeypatch):
    rows = [(i // 2, f"{'alpha beta gamma delta epsilon zeta eta theta iota kappa '[: 60 - i % 3]}\nplain {i % 7} one two three four five six seven") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted(tuple(r) for r in L.report(df).collect())
    monkeypatch.setattr(L, "BROADCAST_LINES", 0)
    assert sorted(tuple(r) for r in L.report(df).collect()) == first


def test_crowded_keys_meet_by_fingerprints_alone(monkeypatch):
    """Groups over several batches, strips of few rows: the pairs of different labels near enough, from rows without words."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, (6, 4))
    rows = []
    for key, i, j in [(1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 1, 1), (3, 0, 1)]:
        for side in (0, 1) if i != j else (0,):
            for _ in range(30):
                sims = base[rng.integers(6)] ^ (1 << rng.integers(0, 63, 4))
                rows.append((key, i, j, side, int(rng.integers(1 << 40)), int(rng.integers(5)), int(rng.integers(20, 26)), *sims.tolist()))
    rows.append((4, 0, 1, 1, 7, 7, 20, 0, 0, 0, 0))  # the other block is empty
    want = set()
    for x in rows:
        for y in rows:
            own = x[:3] == y[:3] and x[5] != y[5] and x[4] != y[4] and (x[3] < y[3] or x[1] == x[2]) and min(x[6], y[6]) >= L.SIMILARITY * max(x[6], y[6]) - 1e-9
            if own and sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x[7:], y[7:], strict=True)) <= L.bits_apart(np.array([max(x[6], y[6])]))[0]:
                want.add((min(x[4], y[4]), max(x[4], y[4])))
    monkeypatch.setattr(L, "STRIP", 64)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
    table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f"c{i}" for i in range(11)])
    for step in (7, 40, 1000):
        got = [p for b in L._block_pairs(table.slice(i, step) for i in range(0, len(rows), step)) for p in zip(*b.to_pydict().values(), strict=True)]
        assert want and set(got) == want


def test_similar_decides_all_kinds_of_pairs():
    """Replaced, inserted, moved and doubled words, wide and narrow hashes: as the full table."""
    rng = random.Random(12)
    a, b = [], []
    for _ in range(400):
        x = [rng.choice((rng.randrange(12), rng.getrandbits(31), -rng.getrandbits(31))) for _ in range(rng.randint(1, 70))]
        y = list(x)
        for _ in range(rng.randint(0, 1 + len(x) // 5)):
            q = rng.randrange(len(y) + 1)
            y[q : q + rng.randint(0, 1)] = [rng.choice(x)] * rng.randint(0, 1)
        if rng.random() < 0.1:
            rng.shuffle(y)
        if y:
            a.append(np.array(x, np.int32))
            b.append(np.array(y, np.int32))
    want = [distance(x.tolist(), y.tolist()) <= L.most_edits(max(x.size, y.size)) for x, y in zip(a, b, strict=True)]
    assert L._similar(a, b).tolist() == want and 50 < sum(want) < len(want) - 50


def test_what_leaves_a_crowded_group_are_links_and_not_pairs():
    """Lines alike by fingerprints of which few are linked: pairs without a link don't leave the group, those of long lines do."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 16, 40).astype(np.uint16)
    words = []
    for _ in range(200):
        w = base.copy()
        w[rng.choice(40, 7, replace=False)] = rng.integers(0, 1 << 16, 7)
        words.append(w)
    words += [words[5].copy(), words[6][1:].copy()]
    n = len(words)
    short = [w.tobytes() for w in words] + [None, None]
    cols = [[1] * (n + 2), [0] * (n + 2), [0] * (n + 2), [0] * (n + 2), list(range(n + 2)), list(range(n + 2)), [40] * (n + 2), *[[9] * (n + 2)] * 4]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(short, pa.binary())], [f"c{i}" for i in range(12)])
    got = {p for x in L._block_pairs([batch]) for p in zip(*x.to_pydict().values(), strict=True)}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if distance(words[i].tolist(), words[j].tolist()) <= L.most_edits(40)}
    assert {(5, 200), (6, 201)} <= want and got == want | {(i, j) for j in (n, n + 1) for i in range(j)}


def test_simhash_counts_every_bit():
    """Runs of one to several hundred features, one or several rows: a bit is set if more than half of a run's features have it."""
    rng = np.random.default_rng(9)
    n = np.concatenate([rng.integers(1, 20, 300), [1, 2, 3, 4, 127, 128, 254, 255, 256, 257, 700], rng.integers(1, 260, 40)])
    off = np.concatenate([[0], np.cumsum(n)])
    h = rng.integers(0, 1 << 63, (3, off[-1])).astype(np.uint64) << np.uint64(1)
    h[:, ::2] |= np.uint64(1)
    bits = (h[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    want = np.array([[sum(1 << j for j in np.flatnonzero(2 * bits[r, a:b].sum(axis=0, dtype=np.int64) > b - a).tolist()) for a, b in zip(off, off[1:], strict=False)] for r in range(3)], np.uint64)
    assert (L.simhash(h, off) == want).all() and (L.simhash(h[1], off) == want[1]).all()
    assert L.simhash(np.empty((2, 0), np.uint64), np.zeros(1, np.int64)).shape == (2, 0)


def test_long_lines_are_decided_in_tables():
    """Lines of some hundred words that no count decides: as the full table, and of fewer steps than pairs times diagonals one by one."""
    rng = random.Random(6)
    a, b = [], []
    for i in range(60):
        x = [rng.randrange(400) for _ in range(rng.choice((30, 90, 200, 300)))]
        y = list(x)
        for _ in range(rng.randint(0, 2 * L.most_edits(len(x)))):
            y.insert(rng.randrange(len(y)), y.pop(rng.randrange(len(y))))  # moved: no word is lacking
        if i % 3 == 0:
            y = y[rng.randint(0, 9) :]
        a.append(np.array(x, np.int32) - 200)
        b.append(np.array(y, np.int32) - 200)
    want = [distance(x.tolist(), y.tolist()) <= L.most_edits(max(x.size, y.size)) for x, y in zip(a, b, strict=True)]
    tables, L._few_edits = L._few_edits, None  # none is compared one by one
    try:
        assert L._similar(a, b).tolist() == L._similar(b, a).tolist() == want and 10 < sum(want) < len(want) - 10
    finally:
        L._few_edits = tables


def test_small_groups_are_compared_together(monkeypatch):
    """Crowded keys of few members: one comparison for all of them, with the pairs of one by one."""
    rng = np.random.default_rng(2)
    rows = sorted((int(rng.integers(40)), int(rng.integers(1 << 40)), int(rng.integers(3)), 20, *(int(x) for x in rng.integers(0, 2, 4) << rng.integers(0, 50, 4))) for _ in range(900))
    key, h, label, n, *sims = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4], strict=True))
    none = pa.array([0] * 900, pa.int64())
    batch = pa.RecordBatch.from_arrays([key, none, none, none.cast(pa.int32()), h, label, n, *sims], [f"c{i}" for i in range(11)])
    pairs = lambda: {p for x in L._block_pairs([batch.slice(0, 333), batch.slice(333)]) for p in zip(*x.to_pydict().values(), strict=True)}
    near, calls = L._near, []
    monkeypatch.setattr(L, "_near", lambda *x: calls.append(1) or near(*x))
    together, few = pairs(), len(calls)
    monkeypatch.setattr(L, "FEW", 0)
    assert together == pairs() and together and few == 0 and len(calls) == 40


def test_keys_leave_a_task_by_ranges_and_meet_whole(monkeypatch):
    """Few rows for many keys; every key of several members comes whole, crowded ones also where a range has too many members to wait."""
    rng = np.random.default_rng(5)
    key = np.concatenate([rng.integers(0, 1 << 46, 3000), rng.integers(0, 40, 2000) * (1 << 30) + 7])
    rng.shuffle(key)
    n = key.size
    h, sim = rng.permutation(n), rng.integers(-(2**63), 2**63 - 1, n)
    blocks = pa.array([int(k).to_bytes(8, "little")[:6] for k in key], pa.binary())
    source = pa.RecordBatch.from_arrays([pa.array(h), pa.array(sim), pa.array(np.full(n, 9, np.int32)), blocks], names=["h", "sim", "n", "blocks"])
    values, size = np.unique(key, return_counts=True)
    size = size[np.searchsorted(values, key)]
    for once, waiting in ((1 << 18, 1 << 22), (700, 60)):
        monkeypatch.setattr(L, "AT_ONCE", once)
        monkeypatch.setattr(L, "WAITING", waiting)
        rows = pa.Table.from_batches(list(L._keys(5)([source.slice(0, 1200), source.slice(1200)]))).sort_by("part").combine_chunks()
        assert rows.num_rows <= 32 * -(-n // once)
        got = pa.Table.from_batches(list(L._in_order(rows.to_batches(max_chunksize=3)))).to_pandas()
        assert set(zip(got.key, got.h, strict=True)) == {(k, i) for k, i, s in zip(key.tolist(), h.tolist(), size, strict=True) if s > 1}
        met = pa.Table.from_batches(list(L._met(iter(rows.to_batches(max_chunksize=3))))).to_pandas()
        hot = met[met.b.isna()]
        assert set(zip(hot.key.astype(int), hot.a, strict=True)) == {(k, i) for k, i, s in zip(key.tolist(), h.tolist(), size, strict=True) if s > L.WINDOW + 1}


def test_only_wanted_lines_are_hashed(monkeypatch):
    """Of a document's lines only those that are compared become words again."""
    text = "\n".join(f"line {i} of a document with words" for i in range(500))
    h = L._lines_of([text])[2].view(np.int64)
    wanted = pa.array([[{"line_no": 7, "h": int(h[7])}, {"line_no": 400, "h": int(h[400])}, {"line_no": 3, "h": 1}]], pa.list_(pa.struct([("line_no", pa.int32()), ("h", pa.int64())])))
    lines, seen = L._lines_of, []
    monkeypatch.setattr(L, "_lines_of", lambda t: seen.extend(t) or lines(t))
    got = pa.Table.from_batches(list(L._wanted_words([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), wanted], names=["doc_id", "text", "wanted"])])))
    assert got["h"].to_pylist() == [h[7], h[400]] and sum(map(len, seen)) < 200


def test_copies_of_a_common_line_crowd_no_task():
    """Of a group's copies one row carries the count and the fingerprints; classes have all lines, their first place and their size however batches are cut."""
    rng = random.Random(4)
    common = "the same line in every document of all"
    texts = [f"{common}\nown line number {i} of this one\n{common}\nshort" for i in range(50)]
    ids = list(range(50))
    rng.shuffle(ids)
    docs = lambda a, b: pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(texts[a:b])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(list(L._lines([docs(0, 20), docs(20, 50)])))
    assert rows.num_rows == 150 and rows["copies"].null_count == rows["blocks"].null_count == 98
    assert sorted(rows["copies"].drop_null().to_pylist()) == [1] * 50 + [40, 60]
    rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("line_no", "ascending")]).combine_chunks()
    for step in (1, 7, 200):
        got = pa.Table.from_batches(list(L._classes(iter(rows.to_batches(max_chunksize=step)))))
        assert sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "line_no", "h")), strict=True)) == sorted(zip(*(rows[c].to_pylist() for c in ("doc_id", "line_no", "h")), strict=True))
        classes = got.filter(got["size"].is_valid()).to_pylist()
        assert len(classes) == 51 and sum(c["size"] for c in classes) == 150 and all(c["blocks"] is not None for c in classes)
        assert [(c["first_doc"], c["first_line"]) for c in classes if c["size"] == 100] == [(0, 0)]
    assert list(L._classes(iter([]))) == []
