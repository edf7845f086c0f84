"""Text of pages, against the standard library's parser."""

import random
import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import functions as F

from terrajobs.functions import markup

PAGES = "/root/testdata/sf0.01/pages.parquet"


class Parser(HTMLParser):
    def __init__(self, hidden):
        super().__init__(convert_charrefs=True)
        self.hidden, self.open, self.out = hidden, [], []

    def handle_starttag(self, tag, attrs):
        if tag not in markup.VOID_ELEMENTS:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if (self.open[-1] if self.open else "") not in self.hidden:
            self.out.append(data)


def parsed(html, hidden=markup.HIDDEN_ELEMENTS):
    if html is None:
        return None
    parser = Parser(hidden)
    parser.feed(html)
    parser.close()
    return re.sub(r"\s+", " ", re.sub(r"[^\w.]|_", " ", " ".join(parser.out).lower())).strip()


def texts(spark, pages, f):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r["t"] for r in df.select("i", f("html").alias("t")).orderBy("i").collect()]


def agree(spark, pages):
    assert texts(spark, pages, markup.html_to_text) == [parsed(p) for p in pages]
    assert texts(spark, pages, markup.html_to_all_text) == [parsed(p, frozenset()) for p in pages]


def test_a_page(spark):
    page = "<html><head><title>Titolo</title></head><body><script>var t='</p>';</script><p>Ciao <b>Mondo</b>!</p><header>no</header></body></html>"
    assert texts(spark, [page], markup.html_to_text) == ["titolo ciao mondo"]
    assert "no" in texts(spark, [page], markup.html_to_all_text)[0]


def test_broken_markup_as_the_parser_has_it(spark):
    agree(spark, [
        None, "", "plain", "<p>a<b", "<p>x<!-- no", "<title>a<b>c</b>&eacute;</title>d", "<p/>a<script/>b</p>c", "</>a</3>b<?x>c<!y>d", "<p title='a>b'>c", '<p title="a>b" x=y>c', "<P>A<BR>b</P>c",
        "<p>a</p>b", "<style>a&amp;b &eacute;</style>", "<p>İΣΑΣ a_b n.1 x²", "<header><p>x</header>y<p>z", "<a href=x/>in</a>out", "<p>a<!-- <b>no</b> -->b", "<SCRIPT>var</script ><p>a", "<p don't>a</p><i>b",
    ])


def test_character_references(spark):
    refs = ["&eacute;", "&eacuteb", "&notit;", "&notin;", "&foo;", "&amp", "&", "&#", "&#233;", "&#xE9", "&#x1;", "&#0;", "&#128;", "&#x1F600;", "&#xD800;", "&#x110000;", "&#99999999999;", "&bsol;", "&NewLine;", "&#xFDD0;", "&#65535;", "&#150;"]
    values = refs + [f"a{a}{b}b" for a in refs for b in refs]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert [r["t"] for r in df.select("i", markup.unescape(F.col("v")).alias("t")).orderBy("i").collect()] == [unescape(v) for v in values]


def test_random_pages_and_very_long_ones(spark):
    rng = random.Random(7)
    parts = ["<p>", "</p>", "<b class=x>", "</b>", "<header>", "</header>", "<br>", "<br/>", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<!-- <p> -->", "uno ", "Due&amp;", "tr&eacute;", " < ", "</i>", "<i/>", "<html>", "</html>", "4.5"]
    pages = ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(150)]
    pages.append("<p>" + "<i>w&amp;</i>" * 4000 + "</p>no")
    pages.append("".join(rng.choices(parts, k=5000)))
    agree(spark, pages)


def test_no_end_is_text_to_the_end(spark):
    """Where the parser loses or guesses: a script without an end hides the rest, a quote without one ends with its tag."""
    assert texts(spark, ["<p>x<script>1</p>", '<p x="1>a'], markup.html_to_text) == ["x", "a"]
    assert texts(spark, ["<p>x<script>1</p>"], markup.html_to_all_text) == ["x 1 p"]


def test_all_pages_without_python(spark):
    pages = spark.read.parquet(PAGES)
    told = pages.select("html", markup.html_to_text("html").alias("t"), markup.html_to_all_text("html").alias("a"))
    assert "Python" not in told._jdf.queryExecution().executedPlan().toString()
    rows = told.collect()
    assert rows and all(r["t"] == parsed(r["html"]) and r["a"] == parsed(r["html"], frozenset()) for r in rows)
