"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline as C
from conftest import DATA
from test_decontam import brute as leaks
from test_linededup import brute as lines
from test_neardup import brute as groups

from tessera.llm import spm
from tessera.llm._store import written


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        docs = written(stage(spark, docs, DATA), "test")
        after = {r.doc_id: r.text for r in docs.collect()}
        ids = {i for i, _ in before}
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "line_dedup":
            gone = lines(before)
            left = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(i, ())) for i, t in before}
            assert after == {i: t for i, t in left.items() if t.strip() or i not in gone} and len(after) < len(left)
            assert all(t.strip() for t in after.values())  # no document is left empty
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in groups(before).items() if i == c}
        elif name == "decontamination":
            assert set(after) == ids - {i for i, _ in leaks(before, bench)}
        else:
            v = spm.vocabulary(spm.default_model())
            assert set(after) == ids and all(v.decode(r.ids) == r.text for r in docs.collect())
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
        before = list(after.items())


def test_run_gives_the_last_stage(spark):
    got = C.run(spark, DATA)
    assert got.count() > 100 and "ids" in got.columns


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
