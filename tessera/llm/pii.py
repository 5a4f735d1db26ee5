"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans.  The field labels *candidates* as other,
e-mail, IP, card or phone: tokens with an at sign, and numbers of seven digits
or more with their separators (of four dotted parts at least), also where spaces
part them.  Its potentials: one on each candidate's shape, digits, marks and the
word before it, one on each pair of neighbours, and one between a candidate and
the *hub* of all candidates of its document that are the same or end in the same
nine digits.  Sum-product messages pass over all edges, loops included, in each
document until they settle; through a hub any two occurrences are two steps
apart, however many lie between.  Occurrences of a hub that have the mark (plus
sign) share one vote, and so do those that have none, since they are one
observation repeated.  The labels that base spans show are given.  So a number that one place marks as a phone is marked
wherever and however often the document repeats it, whatever its punctuation.  A
candidate whose marginal for a label reaches ``SURE`` and that no base span
touches is added as ``crf_<kind>``.

The weights are fitted by pseudo-likelihood in numpy on a bounded sample (at
most about ``SAMPLE`` documents with such candidates, chosen by a hash of the id)
with the base spans as labels.  Every candidate counts twice, once without its
mark (plus sign), so that the field learns how likely an unmarked number is what
a marked one of its shape is; a candidate without a label whose hub has a labelled
one is left out, since its label is not known.

Defined results: null text has no spans; offsets are code points, ends
exclusive; repeated rows give equal rows, whatever rows are beside them; in an
empty table nothing is fitted and nothing found; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import few_rows, groups

SAMPLE = 3_000
SURE = 0.9
#: Potential of a label that a base span shows.
CERTAIN = 30.0
#: Change of a document's messages below which they have settled, and the rounds after which they count as settled; the damped messages of a document settle in some tens.
SETTLED, ROUNDS = 1e-5, 2_000
FEATURES = 1 << 12
KINDS = ("email", "ip", "card", "phone")
N = len(KINDS) + 1  # label 0 is "other"

# fixed values: the base patterns
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# the same matches as EMAIL and IP, found without trying every place of a long run
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_QUADS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")

_ANY = re.compile(r"[0-9@+]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z_@+])[+(]*+[0-9](?:[\x20().-]{0,2}[0-9])*+")
_SPACE = frozenset("\x20\t\n\v\f\r")
_WORD = re.compile(r"[0-9A-Za-z_@]")
_LEAD = re.compile(r"[^0-9A-Za-z+(@]*+")
_CORE_END = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789)")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The matches of EMAIL: from each at sign to the left and to the right."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _core(token: str) -> tuple[int, int]:
    """Where a token begins and ends without the marks around it."""
    a, b = _LEAD.match(token).end(), len(token)
    while b > a and token[b - 1] not in _CORE_END:
        b -= 1
    return a, b


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places that (kind, start, end) cover, as disjoint stretches in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _touches(covered: list[tuple[int, int]], a: int, b: int) -> bool:
    i = bisect_left(covered, (b,))  # the stretches that begin before b
    return i > 0 and covered[i - 1][1] > a


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _QUADS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _tokens(text: str) -> list[tuple[int, int]]:
    """The tokens with an at sign, without the marks around them."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > last and text[a - 1] not in _SPACE:
            a -= 1
        while b < len(text) and text[b] not in _SPACE:
            b += 1
        x, y = _core(text[a:b])
        if x < y:
            out.append((a + x, a + y))
        last, at = b, text.find("@", b)
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Places that could be personal data, in order."""
    mails = _tokens(text)
    covered, out = _merged([(0, a, b) for a, b in mails]), list(mails)
    for m in _NUMBER.finditer(text):
        t = m[0]
        if m.end() < len(text) and _WORD.match(text, m.end()):
            continue
        if sum(map(str.isdigit, t)) >= 7 or t.count(".") == 3:
            if not _touches(covered, m.start(), m.end()):
                out.append(m.span())
    return sorted(out)


def _shape(t: str) -> str:
    """Runs of digits and letters with their lengths, and the marks between them; runs of runs beyond a dozen count alike."""
    parts = [f"9{min(len(m[0]), 20)}" if m[0][0].isdigit() else "a" if m[0][0].isalpha() else m[0] for m in re.finditer(r"[0-9]+|[^\W\d_]+|[\W_]", t)]
    return "".join(parts) if len(parts) <= 12 else f"many{zlib.crc32(''.join(parts).encode())}"


class Graph:
    """The candidates of some texts, their features, and the edges of the field.

    ``chain``: pairs of neighbours; ``hub``: candidate and hub, hubs being numbered
    after the candidates; ``mark``: whether a feature is a mark's; ``share``: of a
    candidate in the vote of those like it.
    """

    def __init__(self, texts: list):
        self.doc, self.start, self.end, self.core, share = [], [], [], [], []
        chain, hub_doc, member = [], [], []
        feats: list[list[int]] = []
        marks: list[list[bool]] = []
        for d, text in enumerate(texts):
            if not text:
                continue
            last, seen, read = None, {}, 0
            for a, b in candidates(text):
                i = len(self.doc)
                t = text[a:b]
                self.doc.append(d)
                self.start.append(a)
                self.end.append(b)
                self.core.append(t)
                share.append(1.0)
                digits = _NOT_DIGIT.sub("", t)
                bare = t.lstrip("+")
                shape = _shape(bare)
                before = text[max(read, a - 24) : a].split()[-1:] or [""]
                names = [f"s{shape}", f"n{min(len(digits), 20)}", f"w{before[0].lower()}", "@" if "@" in t else "-", "quad" if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", t) else "", "luhn" if 13 <= len(digits) <= 19 and luhn(digits) else ""]
                names.append("+" if t[0] == "+" else "")
                own = [n for n in names if n]
                feats.append([zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in own])
                marks.append([n == "+" for n in own])
                if last is not None and a - last[1] <= 3:
                    chain.append((last[0], i))
                last, read = (i, b), b
                key = t.lower() if "@" in t or t.count(".") == 3 and len(digits) <= 12 else digits[-9:]
                seen.setdefault(key, []).append(i)
            for same in seen.values():
                if len(same) > 1:
                    member += [(i, len(hub_doc)) for i in same]
                    hub_doc.append(d)
                    marked = sum(self.core[i][0] == "+" for i in same)
                    for i in same:
                        share[i] = 1 / (marked if self.core[i][0] == "+" else len(same) - marked)
        self.size, self.share = len(self.doc), np.array(share)
        self.feat = np.concatenate([np.array(f, np.int64) for f in feats]) if feats else np.empty(0, np.int64)
        self.mark = np.concatenate([np.array(m, bool) for m in marks]) if marks else np.empty(0, bool)
        self.off = np.concatenate([[0], np.cumsum([len(f) for f in feats])]).astype(np.int64)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.hubs = len(hub_doc)
        self.hub = np.array(member, np.int64).reshape(-1, 2) + np.array([0, self.size])

    def labels(self, base: list) -> np.ndarray:
        """The kind of each candidate that a base span touches, from the base spans of each text; 0 for the others."""
        y = np.zeros(self.size, np.int64)
        by_doc: dict[int, list] = {}
        for i, (d, a, b) in enumerate(zip(self.doc, self.start, self.end, strict=True)):
            if d not in by_doc:
                by_doc[d] = [_merged([s for s in base[d] if s[0] == k]) for k in range(len(KINDS))]
            y[i] = next((k + 1 for k, covered in enumerate(by_doc[d]) if _touches(covered, a, b)), 0)
        return y


class Field:
    """Weights of the skip-chain field."""

    def __init__(self):
        self.unary = np.zeros((FEATURES, N))
        self.bias = np.zeros(N)
        self.pair = np.zeros((N, N))
        self.same = np.zeros(N)

    def potentials(self, g: Graph) -> np.ndarray:
        return (np.add.reduceat(self.unary[g.feat], g.off[:-1], axis=0) + self.bias) * g.share[:, None] if g.size else np.empty((0, N))

    def marginals(self, g: Graph, seen: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product: the marginal of each candidate's label, given those that base spans show (``seen``, 0 for none).  A document's messages stop once they have settled, so its result doesn't depend on the others."""
        phi = np.concatenate([self.potentials(g), np.zeros((g.hubs, N))])
        if seen is not None:
            at = np.flatnonzero(seen)
            phi[at, seen[at]] += CERTAIN
        edges = np.concatenate([g.chain, g.hub])
        if not len(edges):
            return _softmax(phi)
        psi = np.concatenate([np.broadcast_to(self.pair, (len(g.chain), N, N)), np.broadcast_to(np.diag(self.same), (len(g.hub), N, N))])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        n = len(edges)
        back = np.concatenate([np.arange(n) + n, np.arange(n)])
        doc = np.tile(np.array(g.doc, np.int64)[edges[:, 0]], 2)  # of each message
        msg = np.zeros((2 * n, N))
        for _ in range(ROUNDS):
            belief = phi.copy()
            np.add.at(belief, dst, msg)
            new = (belief[src] - msg[back])[:, :, None] + psi
            top = new.max(axis=1)
            new = top + np.log(np.exp(new - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.zeros(doc.max() + 1)
            np.maximum.at(change, doc, np.abs(new - msg).max(axis=1))
            moving = change[doc] >= SETTLED
            if not moving.any():
                break
            msg[moving] = 0.5 * msg[moving] + 0.5 * new[moving]
        belief = phi.copy()
        np.add.at(belief, dst, msg)
        return _softmax(belief[: g.size])


def _softmax(z: np.ndarray) -> np.ndarray:
    if not len(z):
        return z
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Weights by pseudo-likelihood: each candidate given its neighbours' labels and its hub's, with and without its mark."""
    g, f = Graph(texts), Field()
    if not g.size:
        return f
    y = g.labels([base_spans(t) if t else [] for t in texts])
    # the label of a hub, as a candidate sees it: how many of the others have each label, at most one vote
    votes = np.zeros((g.hubs, N))
    np.add.at(votes, (g.hub[:, 1] - g.size, y[g.hub[:, 0]]), 1)
    vote = np.zeros((g.size, N))
    if g.hubs:
        others = votes[g.hub[:, 1] - g.size]
        others[np.arange(len(g.hub)), y[g.hub[:, 0]]] -= 1
        others[:, 0] *= others[:, 1:].max(axis=1) == 0  # a labelled occurrence says more than one without label
        vote[g.hub[:, 0]] = np.minimum(others, 1)
    known = (y > 0) | (vote[:, 1:].max(axis=1) == 0)
    node = np.repeat(np.arange(g.size), np.diff(g.off))
    hot = np.eye(N)
    grad2 = [np.full_like(w, 1e-6) for w in (f.unary, f.bias, f.pair, f.same)]
    plain = np.flatnonzero(~g.mark)
    for _ in range(steps):
        side = np.zeros((g.size, N))
        if len(g.chain):
            np.add.at(side, g.chain[:, 1], f.pair[y[g.chain[:, 0]]])
            np.add.at(side, g.chain[:, 0], f.pair[:, y[g.chain[:, 1]]].T)
        side += vote * f.same
        du, d = np.zeros_like(f.unary), np.zeros((g.size, N))
        for some in (np.arange(g.feat.size), plain):
            z = np.tile(f.bias, (g.size, 1))
            for c in range(N):
                z[:, c] += np.bincount(node[some], f.unary[g.feat[some], c], minlength=g.size)
            one = (_softmax(z * g.share[:, None] + side) - hot[y]) * known[:, None] / (2 * g.size)
            for c in range(N):
                du[:, c] += np.bincount(g.feat[some], (one[:, c] * g.share)[node[some]], minlength=FEATURES)
            d += one
        dp = np.zeros_like(f.pair)
        if len(g.chain):
            np.add.at(dp, y[g.chain[:, 0]], d[g.chain[:, 1]])
            np.add.at(dp.T, y[g.chain[:, 1]], d[g.chain[:, 0]])
        for w, dw, s in zip((f.unary, f.bias, f.pair, f.same), (du, (d * g.share[:, None]).sum(axis=0), dp, (vote * d).sum(axis=0)), grad2, strict=True):
            dw = dw + decay * w / g.size
            s += dw * dw
            w -= rate * dw / np.sqrt(s)
    f.same = np.clip(f.same, 6.0, 10.0)  # repeats agree, also where the sample has few, and no repeat outweighs everything
    return f


def spans_of(texts: list, field: Field) -> list[tuple[list, list]]:
    """For each text: base spans (kind, start, end), and the spans the field adds."""
    base = [base_spans(t) if t and _ANY.search(t) else [] for t in texts]
    own = [t if t and _ANY.search(t) else None for t in texts]
    covered = [_merged(x) for x in base]
    added: list[list] = [[] for _ in texts]
    g = Graph(own)
    if g.size:
        p = field.marginals(g, g.labels(base))
        best = p[:, 1:].argmax(axis=1)
        for i in np.flatnonzero(p[np.arange(g.size), best + 1] >= SURE).tolist():
            d, a, b = g.doc[i], g.start[i], g.end[i]
            if a < b and not _touches(covered[d], a, b):
                added[d].append((int(best[i]), a, b))
    return list(zip(base, added, strict=True))


def fit(docs: DataFrame) -> Field:
    """Weights from at most about SAMPLE documents that have candidate tokens."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@+]") & F.col("doc_id").isNotNull())
    n = rows.count()
    if not n:
        return Field()
    pick = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(pick < min(1.0, SAMPLE / n)).toPandas().sort_values(["doc_id", "text"])
    return train(got.text.tolist())


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for b in few_rows(batches):
            texts = b.column(1).to_pylist()
            got = [x for i, j in groups(texts) for x in spans_of(texts[i:j], shared.value)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            named = lambda spans, mark: [{"kind": mark + KINDS[k], "start": s, "end": e} for k, s, e in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([named(x, "") for x, _ in got], kind), pa.array([named(y, "crf_") for _, y in got], kind)], names=["doc_id", "base", "added"])

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id long, base {span}, added {span}")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row."""
    found = find(docs, fit(docs))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = [F.aggregate("base", F.lit(0).cast("long"), lambda a, x: a + (x["kind"] == kind).cast("long")).alias(f"n_{kind}") for kind in KINDS]
    order = F.array(*[F.lit(m + k) for m in ("", "crf_") for k in KINDS])
    keyed = F.transform(F.concat("base", "added"), lambda x: F.struct(F.array_position(order, x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.select("doc_id", *n, F.sha2(text("base"), 256).alias("base_sha256"), text(F.array_sort(keyed)).alias("spans"), F.size("added").cast("long").alias("n_added"))
