import random

import numpy as np
import pytest
from conftest import DATA

from tessera.llm import spm as P


@pytest.fixture(scope="module")
def model():
    return P.default_model()


def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@pytest.mark.parametrize("letters", ["abcdeth 12é漢 \n", "aabth", "ab ", "漢é\t", "the\u0000😀"])
def test_parts_equal_the_library(model, letters):
    """Exact ids, however the text is split."""
    v, rng, sp = P.vocabulary(model), random.Random(len(letters)), library(model)
    for _ in range(60):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 300)))
        for part in (20, 48, 1000):
            ids = P.encode(t, model, part).tolist()
            assert v.decode(ids) == t and ids == sp.encode(t)


def test_matrices_combine_associatively(model):
    v = P.vocabulary(model)
    text = "ab" * 100 + "thething" * 20
    m = [v.matrix(*p) for p in P.split(text, 40, v.longest)]
    left = P.product(P.product(m[0], m[1]), m[2])
    right = P.product(m[0], P.product(m[1], m[2]))
    assert np.array_equal(left, right) and len(m) > 5 and m[1].shape[0] > 1


def test_tree_equals_the_best_path_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 6):
        sizes = [1, *rng.integers(1, 4, n - 1).tolist(), 1]
        m = [np.where(rng.random((a, b)) < 0.3, -np.inf, rng.integers(0, 50, (a, b))) for a, b in zip(sizes, sizes[1:])]
        weight = {p: sum(x[a, b] for x, a, b in zip(m, p, p[1:])) for p in product(*map(range, sizes))}
        got = P.combine(m)
        assert [b for _, b in got[:-1]] == [a for a, _ in got[1:]]
        if max(weight.values()) > -np.inf:
            assert sum(x[s] for x, s in zip(m, got)) == max(weight.values())


@pytest.mark.parametrize("letters", ["abcdeth 12é漢 \n", "aabth", "ab ", "漢é\t", "the\u0000😀", "  a\n", "thing and the "])
def test_chunks_equal_the_library(model, letters):
    """Every text goes through the scan; ends inside words, in runs of spaces and in long words give the library's ids."""
    v, rng, sp = P.vocabulary(model), random.Random(len(letters)), library(model)
    opened = 0
    for _ in range(60):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 400)))
        for size in (20, 48, 90):
            parts = P.chunks(t, size, v.longest)
            opened += sum(1 for p in parts if p[2])
            assert "".join(p[0] for p in parts) == " " + t
            got, n = P.ids_of(v, t, size)
            assert n == len(parts) and np.frombuffer(got, np.int32).tolist() == sp.encode(t)
    assert opened or " " not in letters or letters == "ab " or letters[:2] == "  "


def test_the_query_goes_through_the_scan(spark, model):
    """Documents of more than a chunk have open ends, matrices of several states, and the library's ids."""
    import hashlib

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    v, sp = P.vocabulary(model), library(model)
    text = {r.doc_id: r.text for r in d.collect()}
    many = 0
    for r in P.digest(d).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(sp.encode(text[r.doc_id]), "<i4").tobytes()).hexdigest()
        if r.n_parts > 1:
            many += max(v.matrix(*p).shape[0] for p in P.chunks(text[r.doc_id], P.CHUNK, v.longest)) > 1
    assert many >= 0.05 * len(text)


def test_documents_round_trip(spark, model):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    got = P.digest(d).collect()
    assert len(got) == d.count() and all(r.round_trip for r in got)
    sp = library(model)
    for r in P.decode_documents(P.encode_documents(d, part=200)).collect():
        assert r.decoded == r.text and r.n_ids == len(r.ids) and r.ids == sp.encode(r.text)


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 100_000, "c"), (4, "a▁b  ", "d"), (4, "a▁b  ", "d"), (None, "\0\n", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = P.decode_documents(P.encode_documents(d)).collect()
    assert len(got) == 6 and all(r.decoded == r.text for r in got)
    assert [r.ids for r in got if r.doc_id == 1] == [None] and [r.n_ids for r in got if r.doc_id == 2] == [0]
    assert next(r.n_parts for r in got if r.doc_id == 3) > 1
    assert P.encode_documents(d.where("false")).count() == 0


def test_line_ends_are_cuts(model):
    sp = library(model)
    texts = ["\n", " \n", "\n ", "  \n", "a \nb", "a\n b", "one two.\nThree  four \n\n five", "x " * 40 + "\n" + " " * 7, " \n日本 é\n"]
    for t in texts * 2:  # the second time from memory
        assert np.frombuffer(P.vocabulary(model).words(t), np.int32).tolist() == sp.encode(t)
        assert P.encode(t, model, 48).tolist() == sp.encode(t)


def test_clashing_columns(spark, model):
    d = spark.createDataFrame([(1, "one two " * 100, 7, "p"), (2, "", 8, None), (3, None, 9, "q")], "doc_id long, text string, _row int, row_parts string")
    got = P.encode_documents(d, model, 64).orderBy("doc_id").collect()
    assert [(r.doc_id, r._row, r.row_parts) for r in got] == [(1, 7, "p"), (2, 8, None), (3, 9, "q")]
    assert got[0].ids == library(model).encode("one two " * 100) and got[0].n_parts > 1 and got[1].ids == [] and got[2].ids is None
