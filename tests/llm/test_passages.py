"""Substring dedup against SQL and plain Python."""

import hashlib
import random

from conftest import DATA, sorted_rows

from tessera.llm import passages as S
from tessera.llm import queries as Q


def brute(rows):
    """doc_id, n_words, n_removed and digest of (doc_id, text) rows."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i : i + 50])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_query_equals_sql(spark, duck):
    df = Q.queries()["op12_substring_dedup"](spark, DATA)
    want = duck.sql(S.ORACLE_SQL)
    rows = df.collect()
    assert sorted_rows(df.columns, rows) == sorted_rows(want.columns, want.fetchall())
    assert sum(r.n_removed for r in rows) > 1000


def corpus():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 120, 400)]
    rows = [(i, f"{text(rng.randrange(60))}\n{rng.choice(passages)}\t {text(rng.randrange(60))}") for i in range(60)]
    base = text(300)
    for i in range(60, 90):  # near copies
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(300)] = word()
        rows.append((i, " ".join(w)))
    rows += [(200 - i, f"{text(20)} {passages[4]} {text(20)}") for i in range(60)]  # ids fall
    rows += [(300, "a " * 500), (301, "a " * 120 + "b " * 60 + "a " * 70), (302, "a b " * 90), (303, "b a " * 90)]
    rows += [(400, None), (401, ""), (402, " \n\x0b "), (403, passages[5]), (403, passages[5]), (403, f"x {base}"), (None, passages[5]), (None, passages[5]), (404, f"é {passages[5]} 日本"), (405, "z" * 3_000_000 + " " + passages[2])]
    rng.shuffle(rows)
    return rows


def test_odd_rows_equal_plain_python(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as v", "2 as anchor", "'q' as words").repartition(6)
    want = brute(rows)
    assert got(S.report(df)) == want
    assert got(S.report(df, broadcast=0, shard_words=2_000, crowd=5)) == want  # shuffle joins, small shards, most anchors by windows
    assert S.report(df.limit(0)).collect() == []


def test_kept_texts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted(((r.doc_id, hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()) for r in S.deduplicate(df).collect()), key=repr)
    assert texts == sorted(((d, h) for d, _, _, h in brute(rows)), key=repr)


def test_matching_statistics_equal_all_substrings():
    rng = random.Random(4)
    for _ in range(60):
        held = S.Automaton()
        known = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(4)]
        for k in known:
            held.add(k)
        query = [rng.randrange(4) for _ in range(20)]
        has = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        want = [max([n for n in range(1, e + 1) if tuple(query[e - n : e]) in has], default=0) for e in range(1, 21)]
        assert held.matches(query) == want


def test_long_texts_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 7)
    words = [f"w{i}" for i in range(50)]
    for gone in ([], [(0, 50)], [(3, 9), (20, 21), (40, 50)], [(0, 1)], [(49, 50)]):
        kept = [w for n, stay in S._kept("\n ".join(words), gone) for w in stay]
        assert kept == [w.encode() for i, w in enumerate(words) if not any(a <= i < b for a, b in gone)]
