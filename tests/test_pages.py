"""Links, titles and URL parts: the examples of RFC 3986, section 5.4, and odd pages."""

from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from quern.operators.pages import host, links, part, title, with_resolved

BASE = "http://a/b/c/d;p?q"
#: References and what they stand for against BASE (fixed values of RFC 3986, sections 5.4.1 and 5.4.2).
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
    ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x",
}


def test_references(spark):
    rows = [(BASE, r, w) for r, w in EXAMPLES.items()]
    for base in ("https://x.example", "http://u@H.example:80/p/", "http://h/a/b/c?x#y"):
        rows += [(base, r, urljoin(base, r)) for r in ("g", "../g", "#f", "/r", "//o.example/y", "a/b/./c/..", "?z")]
    got = with_resolved(spark.createDataFrame(rows, "base string, ref string, want string"), "base", "ref", "got").collect()
    assert [(r.base, r.ref, r.got) for r in got] == [(r.base, r.ref, r.want) for r in got]


def test_parts(spark):
    urls = ["http://User@Host.Example:8080/a/b?c=d#e", "https://x.example", "/only/path", "mailto:a@b.example", "//h?", "http:///p", ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", *[part(F.col("u"), n).alias(n) for n in ("scheme", "authority", "path", "query", "fragment")], host(F.col("u")).alias("host"))
    for r in df.collect():
        s = urlsplit(r.u)
        assert (r.scheme or "", r.authority or "", r.path, r.query or "", r.fragment or "", r.host) == (s.scheme, s.netloc, s.path, s.query, s.fragment, s.hostname or None), r.u


def test_links_of_odd_pages(spark):
    html = """<!-- <a href="/no1"> --><script>x = '<a href="/no2">'</script><a class='x' href = '/one?a=1&amp;b=2'>x</a><A HREF=two.html>y</A><abbr href="/no3"><a data-href="/no4" href="#f">z</a><a name="n">w</a>
    <a\n href="https://O.example:1/q">v</a><a href=" ../up ">u</a>"""
    rows = [(1, "http://h.example/d/p.html", html), (2, None, '<a href="x">1</a><a href="http://k.example/">2</a>'), (3, "http://h.example/", None), (4, "http://h.example/", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [(r.page_id, r.place, r.href, r.target, r.host) for r in links(pages).orderBy("page_id", "place").collect()]
    assert got == [
        (1, 1, "/one?a=1&b=2", "http://h.example/one?a=1&b=2", "h.example"), (1, 2, "two.html", "http://h.example/d/two.html", "h.example"), (1, 3, "#f", "http://h.example/d/p.html#f", "h.example"),
        (1, 4, "https://O.example:1/q", "https://O.example:1/q", "o.example"), (1, 5, "../up", "http://h.example/up", "h.example"), (2, 1, "x", None, None), (2, 2, "http://k.example/", "http://k.example/", "k.example"),
    ]


def test_titles(spark):
    rows = [("<title>A  &amp;lt;\n b </title><title>no</title>",), ("<script><title>no</title></script>",), (None,), ("<title lang=x>T",), ("<TITLE>&quot;q&quot;</TITLE>",)]
    pages = spark.createDataFrame(rows, "html string")
    assert [r.t for r in pages.select(title(pages).alias("t")).collect()] == ["A &lt; b", None, None, None, '"q"']
