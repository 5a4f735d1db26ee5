"""Conversation structure repair: the cheapest edits that make turns alternate.

A conversation's role initials must read ``(s?(ua)+)?``.  Its rows, in order,
drive a Viterbi search over four states (nothing yet, system, user, assistant).
Every state's best edits are a path in one backpointer tree whose nodes count
what refers to them.  As soon as all states descend from one node, the edits up
to it are final: they are emitted and freed, so memory follows the unresolved
part and not the conversation.  Equal costs are decided on the whole unresolved
edits, of which the least in ASCII order wins.

Spark sorts and streams: a conversation's rows pass through one task in order
(its digest is a hash of the whole repaired text, which has no parallel form)
and are never gathered.  Duplicates are marked before, by a window on role and
text, so no task remembers the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import few_rows

#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The states: nothing yet, after a system, a user or an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or re-roled row is in each state.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of an initial leads.
_KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = ("su", "ua", "au")

BLANK, DUPLICATE, SHORTENED, SOUND = "blank", "duplicate", "truncated", ""


class _Node:
    """An edit and the one before it; ``kids`` and ``held`` (by how many states) are what refers to it."""

    __slots__ = ("edit", "row", "before", "depth", "kids", "held")

    def __init__(self, edit: str, row: tuple | None, before: _Node | None):
        self.edit, self.row, self.before = edit, row, before
        self.depth = before.depth + 1 if before else 0
        self.kids: list[_Node] = []
        self.held = 0
        if before:
            before.kids.append(self)


def _since(node: _Node, depth: int) -> str:
    """The edits of ``node`` beyond ``depth``."""
    found = []
    while node.depth > depth:
        found.append(node.edit)
        node = node.before
    return "".join(reversed(found))


def _first(a: str, b: str) -> int:
    """-1 or 1 if a or b is less whatever follows; 0 if one begins the other."""
    for x, y in zip(a, b, strict=False):
        if x != y:
            return -1 if x < y else 1
    return 0


class Repair:
    """The edits of one conversation: ``push`` rows in order, then ``finish``; both return the edits that have become final, as (edit, role, text).

    ``unresolved`` is the number of nodes that are alive.
    """

    def __init__(self):
        self.root = _Node("", None, None)
        self.unresolved = 0
        self.nodes = {NOTHING: self.root}
        self.costs = {NOTHING: 0}
        self.sign: dict[tuple[int, int], int] = {}
        self.root.held = 1
        self._step({NOTHING: (0, NOTHING, "", ())})

    def push(self, role: str, text: str, fault: str) -> list[tuple]:
        extra = TRUNCATED if fault == SHORTENED else 0
        may_stay = fault not in (BLANK, DUPLICATE)
        best: dict[int, tuple] = {}
        for state, cost in self.costs.items():
            self._offer(best, state, (cost + DELETE, state, "D", (None,)))
            if may_stay:
                kept = _KEEP.get((state, role[:1]))
                if kept is not None:
                    self._offer(best, kept, (cost + extra, state, "K", ((role, text),)))
                to = _NEXT[state]
                self._offer(best, to, (cost + REROLE + extra, state, "R", ((_ROLE[to], text),)))
        return self._step(best)

    def finish(self) -> list[tuple]:
        ends = {s: (self.costs[s], s, "", ()) for s in (NOTHING, ASSISTANT) if s in self.costs}
        best: dict[int, tuple] = {}
        for way in ends.values():
            self._offer(best, 0, way)
        self.cost, state = best[0][:2]
        node, found = self.nodes[state], []
        while node is not self.root:
            found.append((node.edit, *(node.row or (None, None))))
            node = node.before
        return found[::-1]

    def _compare(self, a: tuple, b: tuple) -> int:
        """Of two ways (cost, state before, edits, rows): the order of their whole edits."""
        if a[1] == b[1]:
            return _first(a[2], b[2])
        known = self.sign.get((a[1], b[1]), 0)
        if known:
            return known
        x, y = self.nodes[a[1]], self.nodes[b[1]]  # one path begins the other
        least = min(x.depth, y.depth)
        return _first(_since(x, least) + a[2], _since(y, least) + b[2])

    def _offer(self, best: dict, state: int, way: tuple) -> None:
        old = best.get(state)
        if old is None or way[0] < old[0] or way[0] == old[0] and self._compare(way, old) < 0:
            best[state] = way

    def _step(self, best: dict[int, tuple]) -> list[tuple]:
        for _ in range(2):  # more than two inserts in a row come back to a state at a higher cost
            for state, (cost, before, edits, rows) in list(best.items()):
                to = _NEXT[state]
                self._offer(best, to, (cost + INSERT, before, edits + "I", (*rows, (_ROLE[to], ""))))
        least = best[ASSISTANT][0]
        if NOTHING in best and best[NOTHING][0] > least + DELETE:
            del best[NOTHING]  # what it may keep later, a system row, costs a deletion after an assistant
        if SYSTEM in best and best[SYSTEM][0] > least:
            del best[SYSTEM]
        states = list(best)
        sign = {}
        for i, a in enumerate(states):
            for b in states[i + 1 :]:
                if s := self._compare(best[a], best[b]):
                    sign[a, b], sign[b, a] = s, -s
        made: dict[tuple, _Node] = {}
        nodes = {}
        for state, (_, before, edits, rows) in best.items():
            node = self.nodes[before]
            for i, (edit, row) in enumerate(zip(edits, rows, strict=True)):
                where = (before, edits[: i + 1])
                if where not in made:
                    made[where] = _Node(edit, row, node)
                    self.unresolved += 1
                node = made[where]
            nodes[state] = node
        for node in nodes.values():
            node.held += 1
        for node in self.nodes.values():
            node.held -= 1
            while node is not self.root and not node.held and not node.kids:
                self.unresolved -= 1
                node.before.kids.remove(node)
                node = node.before
        self.nodes, self.costs, self.sign = nodes, {s: w[0] for s, w in best.items()}, sign
        final = []
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.before = None
            self.unresolved -= 1
            final.append((self.root.edit, *(self.root.row or (None, None))))
            self.root.row = None
        return final


def _blank() -> Column:
    return ~F.col("text").rlike(r"[^\x20\x09-\x0D]")


def filled(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text; a null role or text is one space."""
    space = F.lit(" ")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20 (a null of either is one space there): 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it in place, 4 makes its role user.

    Dropped rows stay with ``dropped`` true, so that their conversation is known.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = filled(conversations).withColumn("_k", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_k") == 0).alias("dropped"), F.explode(copies).alias("_c")).drop("_c")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with each row's first fault: blank, duplicate (role and text stand earlier in the conversation), truncated (its last character that is no space isn't one of ``.!?``), or none."""
    same = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    again = F.row_number().over(same) > 1
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(F.col("dropped"), "").when(_blank(), BLANK).when(again, DUPLICATE).when(~ended, SHORTENED).otherwise(SOUND)
    return rows.repartition("conv_id").withColumn("fault", fault)


def _in_order(rows: DataFrame, dropped: str | None) -> DataFrame:
    """Faults, a conversation's rows together and in order: by turn (nulls first); rows of one turn by role and text, so that copies are neighbours, the first before those that repeat it."""
    rows = filled(rows).withColumn("dropped", F.lit(False)) if dropped is None else rows.withColumnRenamed(dropped, "dropped")
    return faults(rows).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE).select("conv_id", "turn", "role", "text", "fault", "dropped")


def _events(batches) -> Iterator[tuple[str, object]]:
    """Of sorted rows: ("new", conv_id), ("row", (turn, role, fault)), ("edit", (edit, role, text)) and ("end", cost), conversation by conversation."""
    now, repair, began = None, None, False
    for b in few_rows(batches):
        for conv, turn, role, text, fault, dropped in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not began or conv != now:
                if began:
                    yield from (("edit", e) for e in repair.finish())
                    yield "end", repair.cost
                now, repair, began = conv, Repair(), True
                yield "new", conv
            if dropped:
                continue
            yield "row", (turn, role, fault)
            for e in repair.push(role, text, fault):
                yield "edit", e
    if began:
        yield from (("edit", e) for e in repair.finish())
        yield "end", repair.cost


def repair(conversations: DataFrame, dropped: str | None = None) -> DataFrame:
    """conv_id, position (from 1), role and text of the repaired conversations; rows whose column ``dropped`` is true count as gone.

    Conversations without rows, or whose rows are all deleted, have none.  A
    null conv_id is a conversation of its own.  A row whose role has no initial
    of s, u or a can only be re-roled or deleted.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out: dict[str, list] = {"conv_id": [], "position": [], "role": [], "text": []}
        conv, at = None, 0
        for what, x in _events(batches):
            if what == "new":
                conv, at = x, 0
            elif what == "edit" and x[1] is not None:
                at += 1
                for k, v in zip(out, (conv, at, x[1], x[2]), strict=True):
                    out[k].append(v)
                if len(out["text"]) >= 512:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    for v in out.values():
                        v.clear()
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = _in_order(conversations, dropped)
    schema = pa.schema([("conv_id", _arrow(kind)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return rows.mapInArrow(run, f"conv_id {kind}, position long, role string, text string")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]


def report(conversations: DataFrame, dropped: str | None = None) -> DataFrame:
    """One row for each conv_id of ``conversations`` (plain ones, or those of ``damage`` with its column ``dropped``): gaps in the turns, rows by fault, illegal neighbours, the cost and the initials (audit) of the cheapest edits, and the SHA-256 of the repaired ``role:text`` lines.

    Without a row left: zeros, an empty audit and the hash of an empty text.
    An empty table gives no row; other columns are ignored.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches):
        out: dict[str, list] = {f.name: [] for f in schema}
        for what, x in _events(batches):
            if what == "new":
                n = dict.fromkeys(counts, 0)
                conv, audit, lines, digest = x, [], 0, hashlib.sha256()
                first = last = before = None
                turns = 0
            elif what == "row":
                turn, role, fault = x
                if turn is not None:
                    turns += turn != last
                    first, last = turn if first is None else first, turn
                if fault:
                    n[fault] += 1
                n["illegal"] += before is not None and before + role[:1] not in _LEGAL
                before = role[:1]
            elif what == "edit":
                audit.append(x[0])
                if x[1] is not None:
                    digest.update(("\n" * (lines > 0) + f"{x[1]}:{x[2]}").encode())
                    lines += 1
            else:
                n["cost"] = x
                n["gaps"] = last - first + 1 - turns if turns else 0
                for k, v in {"conv_id": conv, **n, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}.items():
                    out[k].append(v)
                if len(out["cost"]) >= 512:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    for v in out.values():
                        v.clear()
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = _in_order(conversations, dropped)
    schema = pa.schema([("conv_id", _arrow(kind)), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return rows.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")
