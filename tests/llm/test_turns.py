"""Conversation repair against all edits by brute force."""

import hashlib
import itertools
import random
import re
import zlib

from conftest import DATA

from tessera.llm import queries as Q
from tessera.llm import turns as T

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault): every edit of every row, with up to two inserts in each gap."""
    best = None
    gaps = [("", "u", "a", "ua", "au")] * (len(rows) + 1)
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, _, f) in zip(edits, rows, strict=True)):
            continue
        options = [[("D", "", 3)] if e == "D" else [(e, r[:1] or "-", 0)] if e == "K" else [(e, "u", 2), (e, "a", 2)] for e, (r, _, _) in zip(edits, rows, strict=True)]
        extra = sum(e != "D" and f == "truncated" for e, (_, _, f) in zip(edits, rows, strict=True))
        for choice in itertools.product(*options):
            for ins in itertools.product(*gaps):
                initials = ins[0] + "".join(c[1] + i for c, i in zip(choice, ins[1:], strict=True))
                if not re.fullmatch("(s?(ua)+)?", initials):
                    continue
                audit = "I" * len(ins[0]) + "".join(c[0] + "I" * len(i) for c, i in zip(choice, ins[1:], strict=True))
                cost = extra + sum(c[2] for c in choice) + 2 * audit.count("I")
                if best is None or (cost, audit) < best[:2]:
                    name = {"u": "user", "a": "assistant"}
                    lines = [f"{name[x]}:" for x in ins[0]]
                    for c, i, (r, t, _) in zip(choice, ins[1:], rows, strict=True):
                        if c[0] != "D":
                            lines.append(f"{r if c[0] == 'K' else name[c[1]]}:{t}")
                        lines += [f"{name[x]}:" for x in i]
                    best = cost, audit, lines
    return best


def run(rows):
    r = T.Repair()
    found = [e for row in rows for e in r.push(*row)] + r.finish()
    return r.cost, "".join(e[0] for e in found), [f"{e[1]}:{e[2]}" for e in found if e[1] is not None]


def test_every_short_conversation_equals_brute_force():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "u", ""]
    for n in range(5):
        for _ in range((1, 30, 60, 60, 8)[n]):
            rows = [(rng.choice(roles), f"t{i}", rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for i in range(n)]
            assert run(rows) == brute(rows), rows


def test_edits_become_final_while_rows_come():
    r = T.Repair()
    most = 0
    for i in range(20_000):
        r.push("user" if i % 2 else "assistant", "x", "truncated" if i % 7 == 0 else "")
        most = max(most, r.unresolved)
    assert most < 40


def test_two_unresolved_paths_stay_and_ties_are_decided_on_all_of_them():
    rows = [("tool", "x", "")] * 301
    cost, audit, _ = run(rows)
    assert (cost, audit) == (603, "D" + "R" * 300)  # as cheap as the same with the deletion anywhere else, and less
    assert run(rows[:300])[1] == "R" * 300


def expected(table):
    """The report by plain Python."""
    rows, ids = {}, set()
    for conv, turn, role, text in table:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows.setdefault(conv, []).extend([(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1))
    out = {}
    for conv in ids:
        own = sorted(rows.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, lines = run(marked)
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for r, _, _ in marked]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def same(df, want):
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}
    assert got == want


def test_query_equals_plain_python(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    same(Q.queries()["op11_conversation_repair"](spark, DATA), expected([tuple(r) for r in table]))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [
        (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, None, None, "x."), (1, 9, "assistant", None), (None, None, "user", "a."), (None, 3, "assistant", "b"),
        (2, 1, "system", "s."), (2, 2, "", "t."), (2, 3, "assistant", "long " * 50_000 + "end."), (3, 1, "user", "\x0b \t"), (4, -5, "user", "é."), (4, 7, "assistant", " "),
    ]
    rows += [(5, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(1, 40) for _ in range(1 + t % 3)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"{c} {t}.") for c in range(10, 60) for t in range(1, 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    noisy = df.selectExpr("*", "1 as dropped", "2 as fault", "3 as _k", "4 as _c")
    same(T.report(T.damage(noisy), "dropped"), expected(rows))
    assert T.report(T.damage(df.limit(0)), "dropped").collect() == []


def test_repaired_rows_alternate_and_carry_the_report_digest(spark):
    df = T.damage(spark.read.parquet(f"{DATA}/conversations.parquet"))
    lines = {}
    for r in sorted(T.repair(df, "dropped").collect(), key=lambda r: (r.conv_id, r.position)):
        lines.setdefault(r.conv_id, []).append(r)
    for r in T.report(df, "dropped").collect():
        own = lines.get(r.conv_id, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in own))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256
