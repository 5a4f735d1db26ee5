"""Secrets in texts, judged by who else holds them.

Candidates are found with three patterns (assigned values, access keys, long
hex runs) and as *blobs*: runs of 32 or more base64 characters with capital and
small letters and digits.  A candidate's value is hashed, and the corpus gives
the numbers of distinct repositories, owners and documents that hold the hash.
A value in ``SHARED`` repositories or more of two owners or more is a widely
copied example; one that stays with its owner and looks random is live.  Owners are
``source``; repositories are the column ``repository`` (or ``repo``) where the
table has one, else the owner is the one unit.  Counting is two-step (distinct
hash and repository first), so a value that everybody copies is one row a task
before any shuffle, and only the shared values meet the spans again: broadcast
where their counted number is small, else by a join whose hot values Spark splits.

Defined results: null text has no spans; null owner counts as one owner, a null
repository as one repository of its owner; a
repeated row counts once as owner; offsets are code points, ends exclusive;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_enough, written

#: Repositories (of two owners at least) from which a value is an example.
SHARED = 3
#: Bits of entropy a character from which a value looks random.
RANDOM = 3.0

#: Columns that name a document's repository.
REPOSITORY = ("repository", "repo")

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")

# runs of the least length; the same matches as HEX, found faster
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_BLOB = re.compile(r"[A-Za-z0-9+/_-]{32,}")
_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the three patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")) and _HINT.search(text):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """Base spans and blobs that lie outside them."""
    if not text or not _RUN.search(text) and not _HINT.search(text):
        return []
    found = base_spans(text)
    base, i, reach = sorted((s, e) for s, e, _, _ in found), 0, 0
    for m in _BLOB.finditer(text):
        v = m[0]
        while i < len(base) and base[i][0] < m.end():
            reach, i = max(reach, base[i][1]), i + 1
        if reach > m.start():  # a base span touches it
            continue
        if re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v) and entropy(v) >= 4.0:
            found.append((m.start(), m.end(), "blob", v))
    return sorted(found, key=lambda s: (s[0], (*KINDS, "blob").index(s[2])))


def _hash(v: str) -> int:
    return int.from_bytes(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _found(batches):
    """One row a document with its spans as parallel lists."""
    for b in batches:
        rows = [spans(t) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(1),
                b.column(2),
                pa.array([[s[0] for s in r] for r in rows], pa.list_(pa.int64())),
                pa.array([[s[1] for s in r] for r in rows], pa.list_(pa.int64())),
                pa.array([[s[2] for s in r] for r in rows], pa.list_(pa.string())),
                pa.array([[_hash(s[3]) for s in r] for r in rows], pa.list_(pa.int64())),
                pa.array([[entropy(s[3]) for s in r] for r in rows], pa.list_(pa.float64())),
            ],
            names=["doc_id", "owner", "repository", "start", "end", "kind", "value", "entropy"],
        )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, owner, repository and the lists start, end, kind, value (hash), entropy for every row of ``docs`` (doc_id, source, text)."""
    owner = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    repository = next((F.col(c).cast("string") for c in REPOSITORY if c in docs.columns), F.lit(None).cast("string"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), repository.alias("repository"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_found, "doc_id long, owner string, repository string, start array<long>, end array<long>, kind array<string>, value array<long>, entropy array<double>")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories, n_docs (rows): how widely each candidate value is held."""
    unit = F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")
    held = found.where(F.size("value") > 0).select(*unit, F.explode(F.array_distinct("value")).alias("value"))
    by_repository = held.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_docs"))


def shared(found: DataFrame) -> DataFrame:
    """``ownership`` of the values that are widely copied."""
    return ownership(found).where((F.col("n_owners") >= 2) & (F.col("n_repositories") >= SHARED))


def _with_shared(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The spans ``rows`` with n_owners, n_repositories, n_docs where the value is widely copied, else null."""
    often = written(shared(found), "shared")
    return rows.join(F.broadcast(often) if small_enough(often) else often, "value", "left")


def judged(docs: DataFrame) -> DataFrame:
    """One row a span: row (of the input), doc_id, start, end, kind, value, entropy, n_owners, n_repositories, n_docs (null below SHARED), verdict ('live', 'example' or 'weak')."""
    found = written(candidates(docs), "secrets")
    rows = found.where(F.size("value") > 0).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.explode(F.arrays_zip("start", "end", "kind", "value", "entropy")).alias("s")).select("row", "doc_id", "s.*")
    verdict = F.when(F.col("n_owners").isNotNull(), "example").when(F.col("entropy") >= RANDOM, "live").otherwise("weak")
    return _with_shared(rows, found).withColumn("verdict", verdict)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for every row.

    ``spans`` holds the base spans, the blobs, and one ``live`` span over every
    value that stays with its owner.
    """
    found = written(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "blob", "live")])
    rows = found.where(F.size("value") > 0).select("row", F.explode(F.arrays_zip("start", "end", "kind", "value", "entropy")).alias("s")).select("row", "s.*")
    rows = _with_shared(rows, found)
    live = F.col("n_owners").isNull() & (F.col("entropy") >= RANDOM)
    item = F.struct("start", F.array_position(kinds, F.col("kind")).alias("k"), "end", "kind")
    mark = F.struct("start", F.lit(5).cast("long").alias("k"), "end", F.lit("live").alias("kind"))
    by_row = rows.groupBy("row").agg(
        F.array_sort(F.collect_list(item)).alias("all"),
        F.array_sort(F.collect_set(F.when(live, mark))).alias("live"),
        F.count_if(live).alias("n_live"),
        F.count_if(F.col("n_owners").isNotNull()).alias("n_example"),
    )
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda a: F.coalesce(F.array_join(F.transform(a, text), ","), F.lit(""))
    base = F.filter("all", lambda x: x["k"] <= 3)
    n = lambda k: F.coalesce(F.size(F.filter("kind", lambda x: x == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    out = found.select("row", "doc_id", n("assign"), n("access"), n("hex")).join(by_row, "row", "left")
    none = F.array().cast(by_row.schema["all"].dataType)
    every = F.array_sort(F.concat(F.coalesce("all", none), F.coalesce("live", none)))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.coalesce(base, none)), 256).alias("base_sha256"), joined(every).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
