import html as H
import re

from conftest import DATA

from tessera.llm import html as P

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main"><article><h1>Title &amp; more</h1><p>First   line<br>goes on.</p><div class="share">Share this</div><p><b>Second<p>Third &eacute; &#8364; &lt;tag&gt;
<table><tr><td>a</td><td>b</td></tr></table><section class="comments"><p>Nice!</p></section><form><input value=x>send</form></article></div>
<aside><p>Side</p></aside><div class="ad">Buy</div><footer>&copy; me</footer></body></html>"""


def test_page_parts():
    assert P.extract(PAGE, set()) == "Title & more\n\nFirst line goes on.\n\nSecond\n\nThird é € <tag>\n\na b"


def test_odd_pages():
    assert P.extract(None, set()) == "" and P.extract("", set()) == "" and P.extract("<<<>>> & < p", set()) != None  # noqa: E711
    assert P.extract("plain text", set()) == "plain text"
    assert P.extract("<p>one<p>two<ul><li>x<li>y</ul></p>", set()) == "one\n\ntwo\n\nx\n\ny"
    assert P.extract("<article><p>a</article><p>b", set()) == "a"
    assert P.extract("<div hidden>no</div><p a=\"b>c\" d='>'>yes</p><p x=\"open>z", set()).startswith("yes")
    assert P.extract("<b>" * 5000 + "deep" + "</b>" * 5000, set()) == "deep"
    assert P.extract("<a " + "b" * 100_000, set()) is not None


def test_template_is_removed_where_it_recurs(spark):
    frame = '<html><body><div class="top"><span>Welcome to the site</span></div><div><p>{}</p><p>{}</p></div><div><p>All rights reserved by us</p></div></body></html>'
    names = "ash birch cedar elm fir hazel larch maple oak pine rowan yew".split()
    rows = [(i, f"http://a.example/{i}", frame.format(f"Unique text about the {names[i]} and no other tree", f"More {names[i]}"), "x") for i in range(12)]
    rows += [(100, "http://b.example/1", frame.format("Only", "page"), "y"), (101, None, None, None), (102, "nonsense", "", "z")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, template string")
    got = {r.page_id: r for r in P.main_text(d).collect()}
    assert got[3].text == "Unique text about the elm and no other tree\n\nMore elm" and got[3].n_chars == len(got[3].text)
    assert got[100].text.startswith("Welcome") and got[101].text == "" and got[102].n_chars == 0 and got[101].url is None
    assert P.main_text(d.where("false")).count() == 0


def test_copies_of_an_article_stay(spark):
    page = "<article><h1>Same</h1><p>Every copy has this.</p></article><footer>f</footer>"
    d = spark.createDataFrame([(i, "http://c.example/x", page) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in P.main_text(d).collect()} == {"Same\n\nEvery copy has this."}


def test_copies_with_containers_stay(spark):
    page = "<article><div class=body><p>Every copy has this.</p><div><p>And this.</p></div></div></article>"
    bare = "<body><div><p>No article element.</p></div></body>"
    rows = [(i, "http://d.example/x", page) for i in range(20)] + [(100 + i, "http://e.example/x", bare) for i in range(9)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in P.main_text(d).collect()} == {"Every copy has this.\n\nAnd this.", "No article element."}


def test_recurring_box_in_different_articles_goes(spark):
    page = "<article><p>{}</p><div><span>Read our other stories</span></div><p>{}</p></article>"
    d = spark.createDataFrame([(i, "http://f.example/x", page.format(f"Story {'x' * i} " + "word " * 40, f"End {i}")) for i in range(12)], "page_id long, url string, html string")
    assert all("other stories" not in r.text and r.text.endswith(f"End {r.page_id}") for r in P.main_text(d).collect())


def test_given_pages(spark):
    d = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in P.main_text(d).join(d.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_wrappers_and_names_keep_their_text():
    """A word in a class decides only as the head of its name, and never over the article or most of the page."""
    assert P.extract('<div class="page with-sidebar"><article><p>Long body of the page.</p></article></div>', set()) == "Long body of the page."
    assert P.extract('<main><div class="search-results-page"><p>Long body of the page.</p></div></main>', set()) == "Long body of the page."
    page = '<article><p>Text</p><p class="notice-period">Three months.</p><section id="related-work"><p>Others wrote.</p></section><div class="cookie-notice"><p>We use cookies</p></div><ul class="commentList"><li>Nice</li></ul></article>'
    assert P.extract(page, set()) == "Text\n\nThree months.\n\nOthers wrote."
    assert P.extract('<body><div class="sidebar"><p>All that this page says, in the wrong box.</p></div><p>x</p></body>', set()).startswith("All that")
    assert P.extract("<body><form id=aspnet><article><p>Inside a form.</p></article></form></body>", set()) == "Inside a form."
    assert P.extract("<body><form><div><p>Inside a form, without landmark.</p></div></form></body>", set()).startswith("Inside")


def bare(page):
    """A page without its article element, so that only the template tells what is text."""
    return re.sub(r"</?article>|</?nav>|</?footer>", lambda m: m[0].replace("article", "div").replace("nav", "div").replace("footer", "div"), page).replace('class="ad"', "")


def _hosts(spark):
    """The given pages on one large host and one small one, without landmarks."""
    rows = [(r.page_id, f"http://h{r.page_id % 50 // 49}.example/{r.page_id}", bare(r.html)) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_templates_equal_brute_force(spark):
    d, rows = _hosts(spark)
    beside, contents = {}, {}
    for _, url, page in rows:
        found, content = P.hash_subtrees(P.parse(page))
        contents.setdefault(P.host(url), set()).add(content)
        for k in found:
            beside.setdefault((P.host(url), k), set()).add(content)
    want = {hk for hk, c in beside.items() if len(c) >= P.MIN_PAGES and len(c) >= P.SHARE * len(contents[hk[0]])}
    assert {tuple(r) for r in P.templates(P.subtrees(d)).collect()} == want and want


def test_the_template_decides_without_landmarks(spark):
    """Menus, adverts and footers recur on a host's pages: with templates most pages lose them, without they would stay."""
    d, rows = _hosts(spark)
    got = {r.page_id: r.text for r in P.main_text(d).collect()}
    assert got == {r.page_id: r.text for r in P.main_text(d, most=0).collect()}  # the join beyond the broadcast gives the same
    whole = {i: P.extract(page, set()) for i, _, page in rows}
    assert sum(got[i] != whole[i] for i in got) >= 0.5 * len(got)
    article = {r.page_id: r.text for r in P.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert all(all(b in got[i] for b in article[i].split("\n\n") if len(b) > 100) for i in got)  # and the article's paragraphs stay


def test_near_copies_stay(spark):
    """Pages that differ in a date share all their paragraphs, but count as one content."""
    page = "<body><div><p>{}</p><p>The longest paragraph of this page, which all the copies have.</p><p>Another one.</p></div></body>"
    d = spark.createDataFrame([(i, "http://g.example/x", page.format(f"{chr(97 + i)} May")) for i in range(20)], "page_id long, url string, html string")
    assert all("Another one." in r.text and "longest" in r.text for r in P.main_text(d).collect())


def test_menus_of_copies_go(spark):
    """Exact copies on a host lose the menu that the host's other pages show to be template."""
    page = "<body><div>Home News Contact</div><div><p>{}</p></div></body>"
    texts = [f"Story about {'very ' * i}different things" for i in range(10)]
    rows = [(i, "http://k.example/x", page.format(t)) for i, t in enumerate(texts + [texts[0]] * 20)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r.text.startswith("Story about") for r in P.main_text(d).collect())
