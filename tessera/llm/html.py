"""Main text of web pages by site template removal.

Every element subtree of a page is hashed, with digits alike and links left
out.  Spark counts, for each host, beside how many different main contents a
hash occurs; a page's main content is its longest text, so any number of copies
of a page counts once.  A subtree beside ``MIN_PAGES`` different contents, and
``SHARE`` of a host's, is the site's template and is deleted on all its pages.
The hashes kept for a host are bounded: no more than a page's elements over SHARE.

Menus, footers, asides, forms, scripts and styles go by their tag, and the text
is that of the article or main element where a page has one: a host of a few
pages shows no template.  Within that element prose (paragraphs, headings,
quotes, tables) is never deleted for recurring, since articles quote each other.
An element whose class or id is a name for what isn't the article (``NOT_TEXT``,
as the head of its name: ``cookie-notice``, not ``notice-period``) goes, too,
unless it holds the article or more than half of the page's text.

Defined results: null or empty html gives the empty text; a null url is a host
of its own; a page without an article or main element gives the blocks of its
body that are left; unclosed and stray tags are mended as browsers do; repeated
rows are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_enough, written

SHARE = 0.005
MIN_PAGES = 5
#: Hashes of all hosts together that may be broadcast: 8 bytes each.
BROADCAST_KEYS = 1_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav footer aside form button select head dialog menu object canvas audio video map".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table tbody thead tr td th figure figcaption b i em strong a span code br sub sup u s small mark abbr cite q time dl dt dd li ul ol".split())
#: Words of a class, id or role that name what isn't the article.
NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice notification overlay pagination popup promo promoted related replies reply share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar widget contentinfo complementary alert search".split()
)
#: Words after which the word before is the head of a name: comment-list, ad-slot.
LOOSE = frozenset("area bar block box btn button buttons container content feed form group inner item items link links list outer panel row section slot thread title wrap wrapper".split())
#: Words that begin a name of something else: with-sidebar.
OTHER = frozenset("with without has no not is non".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile("[0-9]+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}


class Node:
    """An element: tag, whether its tag rules it out, whether its name does, children (nodes and texts), parent; mark: class, id and role; key: hash, size: characters, off: inside what its tag rules out."""

    __slots__ = ("tag", "out", "named", "kids", "up", "mark", "key", "size", "off")

    def __init__(self, tag, out, up, mark="", named=False):
        self.tag, self.out, self.kids, self.up, self.mark, self.named, self.key, self.size, self.off = tag, out, [], up, mark, named, None, 0, False


def names_no_text(value: str) -> bool:
    """Whether a class, id or role names what isn't the article."""
    for token in value.split():
        parts = [p.lower() for p in _PARTS.findall(token)]
        while len(parts) > 1 and parts[-1] in LOOSE:
            parts.pop()
        if parts and parts[-1] in NOT_TEXT and parts[0] not in OTHER:
            return True
    return False


def _attributes(attrs: str) -> tuple[bool, bool, str]:
    """Whether an element is hidden, whether its name rules it out, and its class, id and role."""
    if not attrs:
        return False, False, ""
    values = [m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)]
    return bool(_HIDDEN.search(attrs)), any(map(names_no_text, values)), " ".join(values)


def parse(page: str) -> Node:
    """The element tree of a page."""
    top = here = Node("", False, None)
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            n = here
            while n.up is not None and n.tag != tag:
                n = n.up
            if n.up is not None:
                here = n.up
            elif tag == "p":
                here.kids.append(Node("p", False, here))
            continue
        if tag == "br":
            here.kids.append(" ")
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            n = here
            while n.up is not None and n.tag not in BLOCK:
                n = n.up
            if n.tag == "p":
                here = n.up
        if tag in _CLOSES:
            n = here
            while n.up is not None and n.tag not in _SCOPE[tag]:
                if n.tag in _CLOSES[tag]:
                    here = n.up
                n = n.up
        attrs = m[4] or m[7] or ""
        hidden, named, mark = _attributes(attrs)
        node = Node(tag, hidden or tag in DROP, here, mark, named)
        here.kids.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            here = node
    if at < len(page):
        here.kids.append(page[at:])
    return top


def _ordered(top: Node) -> list[Node]:
    """All nodes, children before parents, without recursion."""
    out, todo = [], [top]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [k for k in n.kids if type(k) is Node]
    return out[::-1]


def hash_subtrees(top: Node) -> tuple[list[int], int]:
    """Sets every node's key and size; returns the distinct keys of elements that hold text, and a hash of the longest text of one element that no tag rules out."""
    found, longest, content = set(), 0, 0
    order = _ordered(top)
    for n in reversed(order):
        n.off = n.out or n.up is not None and n.up.off
    for n in order:
        h = hashlib.blake2b(_DIGITS.sub("0", f"{n.tag}|{n.mark}|").encode("utf-8", "surrogatepass"), digest_size=8)
        own: list[str] = []
        text = False
        for k in n.kids:
            if type(k) is Node:
                h.update(b"\x01" + (k.key or 0).to_bytes(8, "little", signed=True))
                text = text or k.key is not None
                n.size += 0 if k.out else k.size
            elif not k.isspace():
                own.append(_DIGITS.sub("0", " ".join(k.split())))
                h.update(own[-1].encode("utf-8", "surrogatepass"))
                n.size += len(k)
                text = True
        n.key = int.from_bytes(h.digest(), "little", signed=True) if text else None
        if text and n.up is not None and n.tag != "html":
            found.add(n.key)
        if not n.off and (size := sum(map(len, own))) > longest:
            longest = size
            content = int.from_bytes(hashlib.blake2b(" ".join(own).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return sorted(found), content


def _root(top: Node) -> Node | None:
    """The article: the longest article element outside of menus and the like, else the longest main element."""
    for kind in ("article", "main"):
        best, todo = [], [top]
        while todo:
            n = todo.pop(0)
            if n.tag == kind:
                best.append(n)
            else:
                todo += [k for k in n.kids if type(k) is Node and (not k.out or k.tag == "form")]
        if best:
            return max(best, key=lambda n: n.size)
    return None


def blocks(top: Node, template: set) -> list[str]:
    """The text blocks left of a page whose subtrees are hashed."""
    root = _root(top)
    inside = root is not None
    half = (root.size if inside else max((n.size for n in _ordered(top) if n.tag in ("", "body")), default=0)) / 2
    out: list[str] = []
    line: list[str] = []

    def close():
        text = " ".join(_html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [root if inside else top]
    while todo:
        n = todo.pop()
        if n is None:
            close()
            continue
        if type(n) is str:
            line.append(n)
            continue
        if n is not root:
            if n.out and n.tag not in ("html", "body") and not (n.tag == "form" and n.size > half):
                continue
            if n.named and n.size <= half:
                continue
            if n.tag == "header" and not (inside and any(k.tag in ("h1", "h2") for k in _ordered(n))):
                continue
            if n.key in template and n.tag not in ("html", "body") and not (inside and n.tag in PROSE):
                continue
        wide = n.tag in BLOCK
        if wide:
            close()
            todo.append(None)
        elif n.tag in ("td", "th"):
            line.append(" ")
        todo += n.kids[::-1]
    close()
    return out


def extract(page: str | None, template: set) -> str:
    if not page:
        return ""
    top = parse(page)
    hash_subtrees(top)
    return "\n\n".join(blocks(top, template))


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _hashes(batches):
    for b in batches:
        hosts, keys, contents = [], [], []
        for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            found, content = hash_subtrees(parse(page)) if page else ([], 0)
            hosts.append(host(url))
            keys.append(found)
            contents.append(content)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hosts), pa.array(contents, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["page", "host", "content", "keys"])


def _pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html, the host, and a hash of url and html (page)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    at = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return p.withColumn("host", at).withColumn("page", F.xxhash64("url", "html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """page, host, content and the hashes of the page's subtrees for every page, written."""
    return written(_pages(pages).select("page", "url", "html").mapInArrow(_hashes, "page long, host string, content long, keys array<long>"), "subtrees")


def templates(found: DataFrame, share: float = SHARE, least: int = MIN_PAGES) -> DataFrame:
    """host and key of recurring subtrees.  Copies meet before they are counted, so a hot page is one row a task."""
    beside = found.select("host", "content", F.explode("keys").alias("key")).distinct()
    n = found.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("contents"))
    often = beside.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.join(n, "host").where(F.col("n") >= share * F.col("contents")).select("host", "key")


def main_text(pages: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    The hosts' templates are broadcast while they have ``most`` hashes at most in
    all; beyond that every page gets those that it holds itself, by a join on a
    hash of the page, so neither a hot host nor its html meets in one task.
    """

    def run(batches):
        for b in batches:
            text = [extract(p, set(t or ())) for p, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    found = subtrees(pages)
    t = written(templates(found), "templates")
    if small_enough(t, most):
        own, on = F.broadcast(t.groupBy("host").agg(F.collect_list("key").alias("template"))), "host"
    else:
        held = found.select("page", "host", F.explode("keys").alias("key")).distinct().join(t, ["host", "key"])
        own, on = held.groupBy("page").agg(F.collect_list("key").alias("template")), "page"
    p = _pages(pages).join(own, on, "left").select("page_id", "url", "html", "template")
    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")
