"""Lexical search against SQL, plain Python and exhaustive scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import DATA, sorted_rows

from tessera.llm import lexical as L
from tessera.llm import queries as Q


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    nn, ll = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = set()
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 25 + 75 * n * nn // ll
            s = sum(math.floor(1000 * math.log((2 * nn + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)}
    return out


def test_query_equals_sql(spark, duck):
    df = Q.queries()["op13_lexical_search"](spark, DATA)
    want = duck.sql(L.ORACLE_SQL)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(want.columns, want.fetchall())


def test_odd_rows_equal_plain_python(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Straße", "É", "ß9", "日本語", "a_b", "x\x00y", "K"]  # K is the Kelvin sign, which stays
    docs = [(i, " ".join(rng.choices(words, [1 / (1 + j) for j in range(len(words))], k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(7, "w1 w2 w3"), (500, None), (501, ""), (502, "  ..! "), (None, "w1 w2 w50"), (503, "w5 " * 400_000 + "w59"), (504, "w5" * 700_000), (505, "w1 w2 w3")]
    items = [(1, "W1 w2, w59 w59"), (2, "w1"), (3, None), (4, "nothing here"), (5, "日本語 straße É K k"), (None, "w50 a b")] + [(10 + i, " ".join(rng.choices(words, k=12))) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as terms", "2 as number").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as c", "4 as term")
    named = {(r.item_id, r.rank, r.doc_id, r.score) for r in L.search(d, q).collect()}
    assert named == brute(docs, items)
    assert {(r.item_id, r.rank, r.doc_id, r.score) for r in L.search(d, q, block_terms=40, vocabulary=5).collect()} == named  # blocks of items, all terms indexed
    assert L.search(d.limit(0), q).collect() == [] and L.search(d, q.limit(0)).collect() == []


def test_accumulators_are_limited_and_scores_stay_exact():
    rng = np.random.default_rng(1)
    vocabulary = np.arange(1, 31, dtype=np.uint64)
    tf = [rng.poisson(1.5 * (j + 1) / 30, 5000) for j in range(30)]  # rare to frequent
    tf = np.array(tf).T
    n = tf.sum(axis=1) + 5
    terms = [vocabulary[r > 0].tobytes() for r in tf]
    counts = [r[r > 0].astype(np.uint32).tobytes() for r in tf]
    w = L.weights((tf > 0).sum(axis=0), 5000)
    created, m = [], 25 + 75 * n * 5000 // int(n.sum())
    exact = (np.where(tf > 0, 10**9 * tf // (1000 * tf + 8 * m[:, None]), 0) * w).sum(axis=1)
    best = L.Best(10)
    for part in (slice(0, 2500), slice(2500, 5000)):
        s = L.Segment(pa.array(np.arange(5000)[part]), n[part], terms[part], counts[part], vocabulary, 5000, int(n.sum()))
        created.append(s.rank(np.arange(30), w, best))
    order = np.lexsort((np.arange(5000), -exact))[:10]
    assert best.ids.tolist() == order.tolist() and best.score.tolist() == exact[order].tolist()
    assert max(created) < 2500
