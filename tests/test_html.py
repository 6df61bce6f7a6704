"""HTML parsing on pages of the shapes mails have."""

import pytest

from galley.functions.html_parse import Page, absolute, collapse_lines, dimension, noise_link, parse_page, parse_pages, tidy, tracking_query, widest
from galley.functions.html_tree import Document

CANONICAL = """<html><head><link rel="canonical" href="https://news.example/p/one"><base href="https://news.example/">
<style>p {}</style></head><body><!-- note --><h1>One story</h1><p>First line of it.</p><ul><li>Point <b>one</b></li></ul>
<a href="/p/two?utm_source=mail">Read two</a><img src="/img/a.png" width="640" height="360" alt="Chart">
<img src="https://t.example/open/p.gif" width="1" height="1"><img src="/x/logo.png" width="90" height="90">
<div class="mail footer" role="contentinfo">Legal text <a href="https://news.example/unsubscribe">Unsubscribe</a></div>
<div class="native-ad">Buy</div><script>x()</script></body></html>"""
MULTI = """<html><body><p>Hello there</p><h2>Alpha</h2><p>Text a</p><a href="https://a.example/1">go</a><h2 class="x">Beta</h2><p>Text b<b>bold<p>open
<a href="https://twitter.com/x">t</a><a href="#top">top</a><a href="javascript:x()">j</a><span role="heading">Gamma</span>tail</body></html>"""


def test_canonical_page():
    p = parse_page(CANONICAL)
    assert p["original_url"] == "https://news.example/p/one"
    assert p["links"] == ["https://news.example/p/two?utm_source=mail"]
    assert p["image_urls"] == ["https://news.example/img/a.png"]
    assert "Legal" not in p["plain_text"] and "Buy" not in p["plain_text"] and "x()" not in p["plain_text"] and "note" not in p["plain_text"]
    assert "- Point one" in p["plain_text"] and "Chart" in p["plain_text"]
    assert [s["heading"] for s in p["sections"]] == ["One story"]
    assert p["sections"][0]["text"].startswith("One story")


def test_sections_and_nesting():
    s = parse_page(MULTI)["sections"]
    assert [x["heading"] for x in s] == [None, "Alpha", "Beta", "Gamma"]
    assert [x["section_key"] for x in s] == ["s0", "s1", "s2", "s3"]
    assert s[1]["links"] == ["https://a.example/1"] and s[2]["links"] == []
    assert s[3]["text"] == "Gamma tail"


def test_view_in_browser_and_plain_page():
    p = parse_page('<a href="https://m.example/x">See</a><a href="/web">Read online</a>', "https://m.example/")
    assert p["original_url"] == "https://m.example/web"
    assert len(p["sections"]) == 1 and p["sections"][0]["heading"] is None
    assert parse_page(None)["sections"][0]["text"] == "" and parse_page("")["plain_text_chars"] == 0


def test_footer_by_tag_name_and_short_footer_lines():
    assert parse_page("<p>Keep</p><footer>gone</footer>")["plain_text"] == "Keep"
    assert tidy("Click here to unsubscribe") == ""
    long = "unsubscribe " + "word " * 40
    assert tidy(long) == long.strip()
    assert tidy("https://x.example/?utm_a=1&utm_b=2") == "" and tidy("https://x.example/?a=1&utm_b=2") != ""
    assert collapse_lines("a\nb\n\n c \n") == ["a b", "c"]


@pytest.mark.parametrize(("given", "want"), [("640", 640), ("100%", 100), ("12.7px", 12), ("0", None), ("auto", None), (None, None), ("", None)])
def test_dimension(given, want):
    assert dimension(given) == want


def test_images():
    assert widest("a.png 100w, b.png 300w, c.png 300w") == "b.png" and widest("a.png") == "a.png" and widest(" , ") is None
    page = Page('<img src="https://i.example/b.png"><img src="https://i.example/a.png" width="200" height="200"><img src="https://i.example/c.png" width="5" height="5"><img src="https://i.example/t.png" alt="Twitter">')
    assert page.images(page.doc.nodes()) == ["https://i.example/a.png", "https://i.example/b.png"]


def test_urls():
    assert absolute("https://a.example/x/", "../y") == "https://a.example/y" and absolute("", "mailto:a@b") is None and absolute("https://a.example", " #x") is None and absolute("https://a", "http://[bad") is None
    assert tracking_query("https://a/?utm_source=1&ref=2") and not tracking_query("https://a/?utm_source=1") and not tracking_query("https://a/")
    assert noise_link("https://a.example/preferences", "") and noise_link("https://click.a.example/", "") and noise_link("https://netflix.com/", "") and not noise_link("https://a.example/p/x", "More")


def test_tree():
    d = Document("<div><p>a<p>b</div>c<br>&amp;<i/>")
    assert [d.name[i] for i in d.nodes()] == ["div", "p", "#text", "p", "#text", "#text", "br", "#text", "i"]
    assert d.parent[3] == 1 and d.parent[5] == -1 and d.text[7] == "&"
    deep = Document("<b>" * 5000 + "x")
    assert len(deep.name) == 5001 and deep.end[0] == 5001


def test_spark(spark):
    df = spark.createDataFrame([(1, CANONICAL, None), (2, None, None), (3, MULTI, "https://m.example/")], "email_id long, html string, plain_text string")
    rows = {r.email_id: r for r in parse_pages(df, "email_id", "html").collect()}
    assert len(rows) == 3 and rows[1].original_url == "https://news.example/p/one" and len(rows[3].sections) == 4 and rows[2].plain_text == ""
