import numpy as np
import pytest
from conftest import DATA

from tessera.llm import language_id as L


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).selectExpr("id AS doc_id").select("doc_id", L.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_undetermined_and_odd_rows(spark, docs):
    odd = spark.createDataFrame([(900001, None, None, "s", 0), (900002, "", "en", "s", 0), (900003, "123 !!", None, "s", 6), (None, "Die der und", None, None, None), (900004, "x" * 200_000, None, "s", 1), (900001, None, None, "s", 0)], docs.schema)
    got = L.identify(docs.union(odd)).where("doc_id >= 900000 OR doc_id IS NULL").collect()
    und = [r for r in got if r.lang_pred == "und"]
    assert len(got) == 6 and len(und) == 4 and all(r.score == 0 and r.rejected for r in und)


def test_no_labels_and_empty(spark, docs):
    none = docs.limit(3).withColumn("lang", docs.lang.substr(9, 9).try_cast("int").cast("string"))
    assert {r.lang_pred for r in L.identify(none).collect()} == {"und"}
    assert L.identify(docs.where("false")).count() == 0
    assert L.keep_known(docs.where("false")).count() == 0


def test_keep_known_keeps_clean_rows_and_columns(spark, docs):
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns
    assert kept.count() >= 0.99 * docs.count()


def test_lang_is_no_input(spark, docs):
    m = L.fit(docs)
    a = {r.doc_id: r.lang_pred for r in L.predict(docs, m).collect()}
    b = {r.doc_id: r.lang_pred for r in L.predict(docs.drop("lang", "source"), m).collect()}
    assert a == b


FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "for (int i = 0; i < n; ++i) { buf[i] ^= key[i % klen]; } return memcmp(buf, ref, n) == 0;",
]


def test_rejects_what_was_not_learned_and_keeps_clean_rows(spark, docs):
    """A held-back language, other languages and scripts, code and random letters go; rows that were not learned from stay."""
    import random

    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40)) for _ in range(50)]
    m = L.fit(docs)
    rejected = m.predict(FOREIGN + noise)[2]
    assert rejected.mean() >= 0.98 and rejected[: len(FOREIGN)].all()
    for lang in ("de", "fr"):
        some = L.fit(docs.where(docs.lang != lang))
        texts = [r.text for r in docs.where(docs.lang == lang).collect()]
        assert some.predict(texts)[2].mean() >= 0.9, lang
    clean = [r.text for r in docs.where(L.held_out()).where("text is not null").collect()]
    assert m.predict(clean)[2].mean() <= 0.01


def test_unseen_share_by_brute_force(spark, docs):
    m = L.fit(docs)
    texts = [r.text for r in docs.limit(40).collect()] + FOREIGN + ["", "a", "x y"]
    got = m.logits(texts)[1]
    for t, share in zip(texts, got, strict=True):
        slots = L.subwords([t])[2]
        assert share == (sum(not m.seen[v] for v in slots.tolist()) / slots.size if slots.size else 0.0)
