import re
from collections import Counter

from conftest import DATA

from tessera.llm import rules as R


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(tri)
    hit = {i + j for i, t in enumerate(tri) if often[t] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def check(d):
    rows = R.measure(d).join(d.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.doc_id
        assert not (r.base_failed and r.kept)
    return {r.doc_id: r for r in rows}


def test_documents(spark):
    got = check(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert sum(r.kept for r in got.values()) >= 0.97 * sum(not r.base_failed for r in got.values())


def test_odd_rows(spark):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(40)) for _ in range(3000))
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, "a b c " * 40), (5, "é😀 x\nline\nline\n\n"), (6, noise), (7, " ".join(f"word{i}" for i in range(20_000))), (8, "a b c a b c"), (9, "x" * 100_000)]
    d = spark.createDataFrame([(i, t, True) for i, t in [*rows, (5, rows[4][1])]], "doc_id long, text string, kept boolean")
    got = check(d)
    assert R.measure(d).count() == 10 and not got[4].kept and not got[1].kept and got[5].n_dup_lines == 1
    assert not got[6].kept and not got[6].base_failed  # incompressible
    assert R.measure(d.where("false")).count() == 0
    left = R.filtered(d)
    assert left.columns == d.columns and all(got[r.doc_id].kept for r in left.collect())


def test_bands_and_chunks():
    import zstandard

    p = zstandard.ZstdCompressor(level=R.LEVEL)
    whole, bad = R.compression(b"abc " * 10_000, p)
    assert whole < R.band(40_000)[0] and bad > 0.99  # the last 64 bytes are too short to judge
    assert R.compression(b"", p) == (1.0, 0.0)


def _prose(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    return " ".join(" ".join(t.split()) for t in texts if t and len(t) > 1500)


def test_junk_of_every_length_goes_and_prose_stays(spark):
    """Base64, random letters, and texts half of junk, from 1 to 40 KB, also between 4,096 and 8,192 bytes and in the tail alone."""
    import base64
    import random

    rng = random.Random(5)
    prose = _prose(spark)
    code = lambda n: base64.encodebytes(rng.randbytes(n)).decode().replace("\n", " ")[:n]
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWX" + " " * 9) for _ in range(n))
    words = " ".join(f"w{i}" for i in range(50)) + " "  # so that the count of words passes
    for n in (1_000, 5_000, 12_000, 40_000):
        clean = prose[:n]
        assert R.judge([clean])["kept"] == [True], n
        for junk in (words + code(n), words + letters(n), clean[: n // 2] + " " + code(n // 2), clean[: n // 2] + " " + letters(n // 2)):
            got = R.judge([junk])
            assert got["base_failed"] == [False] and got["kept"] == [False], (n, junk[-60:])
    # a tail of 1,500 bytes after 4,096 counts, too
    assert R.judge([prose[:4096] + " " + code(1_500)])["kept"] == [False]
    # and so do many equal lines after prose
    assert R.judge([prose[:3000] + " " + " ".join(f"{i % 2}" for i in range(1500))])["kept"] == [False]


def test_chunks_equal_brute_force(spark):
    import zstandard

    p = zstandard.ZstdCompressor(level=R.LEVEL)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        raw = (r.text or "").encode()
        parts = [raw[i : i + R.CHUNK] for i in range(0, len(raw), R.CHUNK)]
        out = [c for c in parts if not R.band(len(c))[0] <= len(p.compress(c)) / len(c) <= R.band(len(c))[1]]
        assert R.compression(raw, p)[1] == (sum(map(len, out)) / len(raw) if raw else 0.0)
