import re
from collections import Counter, defaultdict

from conftest import DATA

from tessera.llm import decontam as D


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x.lower())


def brute(docs, items):
    """Pairs with a passage of weighted similarity 0.75 at any place."""
    holds, grams, inv = {}, {}, defaultdict(set)
    for k, t in items:
        w = words(t)
        grams[k] = (len(w), Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)))
        for g in grams[k][1]:
            inv[g].add(k)
    for i, t in docs:
        w = words(t or "")
        s = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for k in {k for g in s for k in inv[g]}:
            n, own = grams[k]
            best = max(D.similarity(own, Counter(s[a : a + n - 4])) for a in range(max(1, len(w) - n + 1)))
            if best >= D.SIMILARITY:
                holds[i, k] = best
    return holds


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    got = {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()}
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert got == set(want)


def test_edited_passages(spark):
    item = " ".join(f"term{i}" for i in range(45))
    w = item.split()
    plain = " ".join(f"filler{i}" for i in range(400))
    swap = " ".join([*w[:20], "changed", *w[21:]])
    drop = " ".join(w[:3] + w[4:])
    rows = [(1, f"{plain} {item} {plain}"), (2, f"{plain[:-2]} {swap} tail"), (3, f"{drop}"), (4, plain), (5, item.upper()), (6, " ".join(w[:25])), (7, None), (8, ""), (None, item), (9, f"{item} " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    got = D.find(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 1), (5, 1), (9, 1)]
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 4, 6, 7, 8]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, n int")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c", 2)], d.schema)
    assert D.find(d, b).count() == 0 and D.find(one, b).count() == 0
    assert D.decontaminate(one, b).collect() == one.collect()


def test_long_items_with_spread_edits():
    """Words dropped or put in evenly over long items: all that brute force finds."""
    items, docs = [], []
    for k, n in enumerate((150, 200, 300, 500, 1000)):
        w = [f"t{k}x{i}" for i in range(n)]
        items.append((k, " ".join(w)))
        step = n // (n // 50 + 1)
        fewer = [x for i, x in enumerate(w) if i % step != step // 2]
        more = [y for i, x in enumerate(w) for y in ([x, f"new{i}"] if i % step == step // 2 else [x])]
        plain = " ".join(f"p{k}x{i}" for i in range(300))
        docs += [(2 * k, f"{plain} {' '.join(fewer)} {plain}"), (2 * k + 1, f"{plain} {' '.join(more)} {plain}")]
    want = brute(docs, items)
    got = {(i, k) for i, k, *_ in D.search([t for _, t in docs], D.Index(items))}
    assert len(want) == 10 and got == set(want)


def test_the_radius_finds_edited_passages_that_equal_fingerprints_miss():
    """Items with as many changed words as the similarity allows: radius 0 loses most of them, RADIUS almost none."""
    import random

    rng = random.Random(3)
    items, docs = [], []
    for k in range(120):
        n = rng.choice((36, 45, 59, 80, 150))
        w = [f"t{rng.randrange(5000)}" for _ in range(n)]
        items.append((k, " ".join(w)))
        for _ in range(n // 36):
            w[rng.randrange(n)] = f"u{rng.randrange(5000)}"
        docs.append((k, " ".join([f"p{rng.randrange(999)}" for _ in range(rng.randint(0, 60))] + w + [f"q{i}" for i in range(50)])))
    want = brute(docs, items)
    find = lambda: {(i, k) for i, k, *_ in D.search([t for _, t in docs], D.Index(items))}
    got, radius = find(), D.RADIUS
    try:
        D.RADIUS = 0
        exact = find()
    finally:
        D.RADIUS = radius
    assert len(want) >= 60 and got <= set(want) and len(got) >= 0.97 * len(want) and len(exact) < 0.6 * len(want), (len(want), len(got), len(exact))


def test_all_pairs_within_the_radius_share_an_entry():
    import numpy as np

    rng = np.random.default_rng(2)
    with np.errstate(over="ignore"):
        index = D.Index([(i, " ".join(f"a{rng.integers(0, 999)}" for _ in range(30))) for i in range(20)])
        w, (_, _, _, fp, _) = next(iter(index.classes.items()))
        flips = [sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 20)), replace=False)) for _ in range(3000)]
        mine = fp[rng.integers(0, fp.size, 3000)] ^ np.array(flips, np.uint64)
        win, entry = index.near(mine, w)
    got = set(zip(win.tolist(), entry.tolist()))
    assert got == {(i, j) for i in range(3000) for j in range(fp.size) if int(mine[i] ^ fp[j]).bit_count() <= D.RADIUS}


def test_very_long_text_and_clashing_columns(spark):
    item = " ".join(f"term{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "plain words " * 150_000 + item, 7, 8.0)], "doc_id long, text string, item_id int, similarity double")
    bench = spark.createDataFrame([(5, item, 1)], "item_id long, text string, doc_id int")
    assert [(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()] == [(1, 5)]
    assert D.decontaminate(docs, bench).columns == docs.columns
