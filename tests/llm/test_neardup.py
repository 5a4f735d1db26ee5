import random
import re

import numpy as np
import pytest
from conftest import DATA

from tessera.llm import neardup as N
from tessera.llm._graph import components


def brute(rows):
    """component_id by comparing all pairs of shingle sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            k = len(x & y)
            if k and 100 * k >= 75 * (len(x) + len(y) - k):
                p, q = find(ids[a]), find(ids[b])
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.components_of(d).collect()}
    assert got == brute(rows)
    return got


def test_documents_equal_brute_force(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in d.collect()])


def test_large_groups_equal_brute_force(spark):
    """A hot group of near copies with outliers around it, and a passage that unrelated texts share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(30)], []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(160, 260):
        rows.append((i, " ".join(passage + [word() for _ in range(rng.randint(3, 60))])))
    rows += [(300 + i, rows[0][1].upper()) for i in range(80)]
    got = check(spark, rows)
    assert len({c for _, c in got.values()}) > 5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "a b"), (5, "A  b"), (6, "b a"), (7, "a b c d e"), (8, "a b c d e"), (9, "x " * 50_000), (10, "x " * 40_000)]
    got = check(spark, rows)
    assert got[1] == (0, 1) and got[5] == (1, 4) and got[8] == (1, 7) and got[10][1] == 9
    d = spark.createDataFrame([*rows, (4, "a b"), (None, "a b")], "doc_id long, text string")
    out = N.components_of(d).collect()
    assert len(out) == 12 and [r.kept for r in out if r.doc_id is None] == [True]
    assert N.components_of(d.where("false")).count() == 0


def test_deduplicate_keeps_columns(spark):
    d = spark.createDataFrame([(1, "a b c d e f", "x", 5), (2, "a b c d e f", "y", 6), (3, None, None, 7), (None, "a b c d e f", "n", 8)], "doc_id long, text string, label string, node int")
    got = N.deduplicate(d)
    assert got.columns == d.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3]


def test_shared_counts():
    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 50, 20)) for _ in range(5)]
    y = [np.unique(rng.integers(0, 50, 30)) for _ in range(7)]
    want = [[np.intersect1d(a, b).size for b in y] for a in x]
    assert N.shared_counts(x, y).tolist() == want


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50), (7, 7)]])
def test_components(spark, edges):
    d = spark.createDataFrame([(a, b) for a, b in edges], "a long, b long")
    got = {r.id: r.component for r in components(d).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            group = {a, b}.union(*[g for g in up.values() if g & {a, b}])
            for i in group:
                up[i] = group
    assert got == {i: min(g) for i, g in up.items()}
