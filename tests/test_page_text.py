"""Page text against the standard parser, on pages of all kinds, and which of them the native path takes."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from curatrix.functions import html

SKIP = {"script", "style", "head", "nav", "footer", "noscript"}
BLOCK = {"p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "li", "tr", "br", "blockquote", "pre"}


class Brute(HTMLParser):
    """Events as they come; the text is made of them afterwards."""

    def __init__(self):
        super().__init__()
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag))

    def handle_endtag(self, tag):
        self.events.append(("close", tag))

    def handle_data(self, data):
        self.events.append(("data", data))


def brute(page: str) -> str:
    parser = Brute()
    parser.feed(page)
    parser.close()
    level, text = 0, ""
    for kind, value in parser.events:
        if kind == "data":
            text += value if level == 0 else ""
        elif value in SKIP:
            level = level + 1 if kind == "open" else max(0, level - 1)
        elif value in BLOCK:
            text += "\n"
    out = []
    for line in (re.sub("[ \t]+", " ", x).strip() for x in text.splitlines()):
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip("\n")


ODD = {
    "nested": "a<nav>b<nav>c</nav>d</nav>e", "crossed": "a<nav>b<footer>c</nav>d</footer>e", "unclosed": "<p>a</p><footer>b<p>c</p>", "stray": "a</nav>b</footer>c", "script": "a<script>if (x<y) { '</p>' }</script>b<p>c", "open script": "a<script>b</p>c",
    "comment": "a<!-- b <p> -- c -->d", "open comment": "a<!-- b", "less": "1 < 2 <p>3<4</p>", "attribute": '<p title="a > b">c</p>d', "self-closing": "a<nav/>b<br/>c<p/>d", "unquoted": "<p class=x/>a<a href=/x/>b</a>", "cut entity": "a &am<b>p;</b> c", "entities": "&lt;p&gt; &copy; &#8217; &amp;lt; &nbsp;x&ampy &",
    "blocks in hidden": "a<nav><ul><li>x</li></ul></nav>b", "head": "<head><title>t</title><style>p{}</style><script>var a='</head>'</script></head><p>b</p>", "custom": "a<my-nav>b</my-nav><p-x>c</p-x>", "declaration": "<?xml version='1.0'?><!DOCTYPE html><![CDATA[x]]>y", "end with attribute": "<div>a</div class='x'>b",
    "textarea": "<textarea><p>a</p></textarea>b", "title": "<title>a<b>c</b></title>d", "upper": "<P>a</P><NAV>b</NAV>c<BR>d", "lines": "a\r\nb\x0bc\u2028d\x85e  \t f", "empty": "", "mark": "a\ue000b<p>c", "trailing": "a<p>b &copy 2024", "script in comment": "a<!-- <script> -->b<p>c</script>d", "comment in script": "a<script><!-- </script>b --> c", "short comment": "a<!--> b -->c<!---> d -->e",
    "noscript": "<noscript><p>a</p></noscript>b", "tag without end": "a<p", "attribute without value": "<p hidden>a</p><input disabled/>b", "double": "<br/><br/>a<br /><br />b", "pre": "<pre> a\n\n\n b</pre>",
}


def test_odd_pages(spark):
    df = spark.createDataFrame(list(ODD.items()), "name string, page string")
    found = {r.name: r for r in df.select("name", html.page_text(F.col("page")).alias("text"), html.is_regular(F.col("page")).alias("regular")).collect()}
    assert {k: r.text for k, r in found.items()} == {k: brute(v) for k, v in ODD.items()}
    irregular = {"nested", "crossed", "unclosed", "stray", "open script", "comment", "open comment", "less", "attribute", "self-closing", "unquoted", "cut entity", "custom", "textarea", "mark"}
    assert irregular <= {k for k, r in found.items() if not r.regular}
    assert {"script", "blocks in hidden", "head", "upper", "noscript", "pre", "double", "lines", "empty"} <= {k for k, r in found.items() if r.regular}


def test_random_pages(spark):
    """Both paths: what the native one takes it reads as the parser does, and the whole does on every page."""
    rng = random.Random(7)
    pieces = ["a ", " b", "\n", "&amp;", "&lt;", "&copy;", "<", ">", "&", "<p>", "</p>", "<br/>", "<li class='x'>", "<nav>", "</nav>", "<footer>", "</footer>", "<head>", "</head>", "<script>", "</script>", "<style>x</style>", "<!-- c -->", "<!--", "-->", "<title>t</title>", "<b>", "</b>", "<div id=\"q\">", "</div>", "<noscript>", "</noscript>", "<script>1<2</script>", "<nav><p>n</p></nav>", "é\u00a0", "/>", "'", '"', "--", "="]
    weights = [3] * 6 + [1] * 3 + [3] * 4 + [1] * 8 + [3] + [3] + [1, 1, 2, 3, 3, 3, 3, 1, 1, 3, 3, 3] + [1] * 5
    pages = ["".join(rng.choices(pieces, weights[: len(pieces)], k=rng.randrange(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, page string")
    rows = df.select("page", html.is_regular(F.col("page")).alias("regular"), html.page_text(F.col("page")).alias("text")).collect()
    wrong = [(r.page, r.regular, r.text, brute(r.page)) for r in rows if r.text != brute(r.page)]
    assert not wrong, wrong[:5]
    assert 0.15 < sum(r.regular for r in rows) / len(rows) < 0.95


def test_null_page(spark):
    assert spark.createDataFrame([(None,)], "page string").select(html.page_text(F.col("page")).alias("t")).first().t == ""


def test_very_long_pages(spark):
    """No step needs a stack as deep as a page is long."""
    pages = ["a<!--" + " x-y " * 100_000 + "-->b", "<script>" + "if (a<b) x(); " * 50_000 + "</script>b", "<nav>a</nav>b<p>" * 20_000, "<p>" + "&amp; x " * 100_000, "<div " + "a='b' " * 3000 + ">c</div>", "<nav>" * 30_000 + "x", "<" * 50_000]
    rows = spark.createDataFrame([(p,) for p in pages], "page string").select("page", html.page_text(F.col("page")).alias("text")).collect()
    assert len(rows) == len(pages) and all(r.text == brute(r.page) for r in rows)
