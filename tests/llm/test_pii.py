import hashlib
import random
import re
import time

import numpy as np
from conftest import DATA

from tessera.llm import pii as P


def base(text):
    """The base spans straight from the rule."""
    text = text or ""
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in digits(m[0])]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def check(d):
    rows = P.report(d).join(d.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        want = base(r.text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in P.KINDS)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    return rows


def test_documents(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


CARD = "4111 1111 1111 1111"


def test_hand_cases(spark):
    rows = [
        (1, f"é😀 {CARD}, me@site.example.org. 10.0.0.256 1.2.3.4.5 +1 (743) 555-3824!", 0),
        (2, None, 1),
        (3, "", 2),
        (4, "no data here", 3),
        (5, "4111111111111112 +12345678 a@b 999.1.1.1", 4),
        (5, "4111111111111112 +12345678 a@b 999.1.1.1", 4),
        (6, "1" * 5000 + ".1.1.1", 5),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = check(d.dropDuplicates(["doc_id"]))
    assert len(got) == 6 and P.report(d).count() == 7
    assert next(r for r in got if r.doc_id == 1).n_ip == 1
    assert P.report(d.where("false")).count() == 0


PHONE = "call 743-555-3824 now " + "and then words " * 50 + "or 7435553824 again 1234567 7654321"


def fitted():
    rng = random.Random(1)
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    texts = [f"mail a{i}@b{i}.example.com or 10.1.2.{i} and +1 (743) 555-38{i:02d} in 20{i:02d}, order {number(8)} or +{number(12)}" for i in range(60)]
    return P.train(texts + [f"order {number(10)} and {number(12)} of {number(7)}" for _ in range(30)])


def test_a_repeat_without_its_mark_is_added():
    """The fitted field marks what the document marks elsewhere, however far, how often, and with whatever punctuation; alone it stays unmarked."""
    f = fitted()
    alone = "ref 442079460958 and words"
    far = " and then words" * 300
    many = "".join(f" 4420 7946 0958{far[:30]}" for _ in range(40))
    text = f"ring +442079460958 today{far} or 442079460958 or (44) 20-79460958 or 0044 20 7946 0958 then{many} but order 12345678 stays"
    (base, none), (marked, added) = P.spans_of([alone, text], f)
    assert not base and not none and [k for k, _, _ in marked] == [3]
    found = [text[a:b] for k, a, b in added if k == 3]
    assert {"442079460958", "(44) 20-79460958", "0044 20 7946 0958"} <= set(found) and found.count("4420 7946 0958") == 40
    assert "12345678" not in found


def test_a_documents_marginals_do_not_depend_on_its_neighbours():
    f = fitted()
    texts = ["+442079460958 and 442079460958", "no", PHONE, "a@b.example.org +12 345 678 901 12345678901"]
    together = P.spans_of(texts * 3, f)
    assert together == [P.spans_of([t], f)[0] for t in texts] * 3
    g = P.Graph(texts)
    parts = np.concatenate([f.marginals(P.Graph([t])) for t in texts if P.Graph([t]).size])
    assert np.array_equal(f.marginals(g), parts)


def brute_marginals(f, g, seen):
    """The sum over all labelings of candidates and hubs."""
    import itertools

    phi = f.potentials(g)
    phi[np.arange(g.size), seen] += P.CERTAIN * (seen > 0)
    want = np.zeros((g.size, P.N))
    for y in itertools.product(range(P.N), repeat=g.size + g.hubs):
        p = np.exp(sum(phi[i, y[i]] for i in range(g.size)) + sum(f.pair[y[a], y[b]] for a, b in g.chain) + sum(f.same[y[a]] * (y[a] == y[b]) for a, b in g.hub))
        for i in range(g.size):
            want[i, y[i]] += p
    return want / want.sum(axis=1, keepdims=True)


def test_marginals_of_the_fitted_field_equal_brute_force():
    """Without loops message passing is exact; with a loop the decisions are the same."""
    f = fitted()
    for text in ("+442079460958 is 442079460958", "a@b.example.org 1.2.3.4 12345678", "+442079460958 x y z 44 207 946 0958 x y z 442079460958"):
        g = P.Graph([text])
        seen = g.labels([P.base_spans(text)])
        assert g.size > 1 and np.allclose(f.marginals(g, seen), brute_marginals(f, g, seen), atol=1e-4)
    text = "+442079460958, 442079460958 or 12345678"
    g = P.Graph([text])
    seen = g.labels([P.base_spans(text)])
    assert g.hubs == 1 and len(g.chain) and np.array_equal(f.marginals(g, seen) >= P.SURE, brute_marginals(f, g, seen) >= P.SURE)


def test_the_query_adds_spans(spark):
    """The field fitted on the given table, over documents in which a phone comes back without its plus sign."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(10_000 + i, f"Ring +44207946{i:04d} soon. {'Some words. ' * 40}Or 44 207946 {i:04d} later.") for i in range(30)], "doc_id long, text string")
    got = P.report(d.select("doc_id", "text").union(more)).where("doc_id >= 10000").collect()
    assert sum(r.n_added >= 1 and "crf_phone" in r.spans for r in got) >= 0.9 * len(got)


def test_training_learns_the_shapes():
    texts = [f"mail a{i}@b{i}.example.com or 10.1.2.{i} and +1 (743) 555-38{i:02d} in 20{i:02d}" for i in range(60)]
    f = P.train(texts)
    g = P.Graph(texts)
    y = g.labels([P.base_spans(t) for t in texts])
    assert (f.marginals(g).argmax(axis=1) == y).mean() > 0.97


def test_scans_equal_the_plain_patterns():
    rng = random.Random(3)
    for letters in ("ab.@-_ 1", "1.2 3.", "é!(@+1a) \n\t日", "a@b.c"):
        for _ in range(3000):
            s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
            assert P._emails(s) == [m.span() for m in P.EMAIL.finditer(s)]
            assert [m.span() for m in P._QUADS.finditer(s)] == [m.span() for m in P.IP.finditer(s)]
            spans = [(0, a, a + rng.randint(1, 4)) for a in rng.sample(range(40), 5)]
            a = rng.randint(0, 40)
            b = a + rng.randint(1, 5)
            assert P._touches(P._merged(spans), a, b) == any(s < b and a < e for _, s, e in spans)


def test_long_runs_take_one_pass():
    began = time.perf_counter()
    P.spans_of(["1.1 " * 60_000 + "x", "a@" * 60_000, "+1234567890 " * 20_000], fitted())
    for s in ("日" * 300_000, "a" * 300_000 + " x@y.zz", "1" * 300_000, "1" + "!" * 300_000 + "é"):
        P.spans_of([s], P.Field())
    assert time.perf_counter() - began < 20
