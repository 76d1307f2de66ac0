"""HTML extraction against an independent reader, on odd markup, and in linear time."""

import time
from html.parser import HTMLParser
from pathlib import Path

import pytest
from lathe.llm import html
from lathe.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """The article element's text, a line for each block, by the standard library's reader; fit for the test tables' markup."""

    BLOCK = {"article", "p", "h1", "h2", "h3", "ul", "li", "div", "table", "tr", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.lines = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "form", "aside", "nav"):
            self.skipped += 1
        if tag == "article":
            self.inside += 1
        if tag in self.BLOCK:
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("script", "style", "form", "aside", "nav"):
            self.skipped -= 1
        if tag in self.BLOCK:
            self.lines.append("")
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.lines[-1] += data


def plain(page):
    reader = Plain()
    reader.feed(page or "")
    reader.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in reader.lines) if x)


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables aren't here")
def test_extraction_equals_an_independent_reader(spark):
    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in html.page_text_report(pages).collect()}
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert got == want and sum(map(len, want.values())) > 100_000


def test_article_text_stays_whatever_its_class_hints_at(spark):
    words = "discussion related side share replies toc login widget header search form banner alert social"
    blocks = "".join(f'<div class="{w}"><p>About {w}, page %d.</p></div>' for w in words.split())
    rows = [(i, f"http://h.io/{i}", f"<body><article><h1>T</h1>{blocks}<section id='comment-on-results'>Kept %d</section><div class='comments'><p>me too</p></div><div class='ad-box'>Buy</div></article></body>".replace("%d", str(i))) for i in range(3)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(3):
        assert got[i] == "\n".join(["T", *(f"About {w}, page {i}." for w in words.split()), f"Kept {i}"])


def test_doubtful_blocks_go_where_the_host_repeats_them_or_links_fill_them(spark):
    page = "<body><article><p>Text {}</p><div class='related'><p>Read our other pages</p></div><div class='share'><a href=x>One</a> <a href=y>Two</a> or</div><div class='side'>Own {}</div></article></body>"
    rows = [(i, "http://a.io/x", page.format(i, i)) for i in range(4)] + [(9, "http://b.io/x", page.format(9, 9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as winner", "'k' as _host", "2 as _names")
    got = {r.page_id: r for r in html.main_text(df).collect()}
    assert got[0].text == "Text 0\nOwn 0" and got[3].text == "Text 3\nOwn 3"
    assert got[9].text == "Text 9\nRead our other pages\nOwn 9"  # one page says nothing of its host
    assert got[0].winner == 1 and got[0]._host == "k" and got[0]._names == 2


@pytest.mark.parametrize("page", ["<div>x" * 100_000, '<a x="' * 180_000, "<a x='b" * 150_000, "<div class=related>x" * 50_000, "<article>" + "<div class=related>x" * 50_000, "<" * 1_000_000, "<!--" * 300_000, "<p><span>" * 100_000, "</div>" * 200_000, "<p>" + "<button><span>" * 30_000 + "<h1>x" * 30_000, "<ul><li>" * 60_000, "<td>x" * 100_000])
def test_odd_markup_takes_linear_time(page):
    began = time.process_time()
    text = html.extract(page, html.best_container(page))
    assert time.process_time() - began < 10 and len(text) <= len(page)


def test_events_of_broken_markup():
    text = lambda page: html.extract(page, html.best_container(page))
    assert text("<body><p>a <b>b<p>c</b> d</p><![CDATA[x < y]]> e &lt; &amp;lt;") == "a b\nc d\nx < y e < &lt;"
    assert text("<p>one<p>two<table><tr><td>a<td>b<tr><td>c</table>") == "one\ntwo\na\nb\nc"
    assert text('<p title="a > b">kept</p><p title="never closed>gone? no') == "kept\ngone? no"
    assert text("a<br>b<script>if (a < b) {}</script><style>p{}") == "a b"
    assert text("<p>x</p></article></p></nope>y") == "x\ny"
    assert html.best_container("") is None and text("") == ""


def test_repeated_and_null_pages(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, "http://a.io", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html.page_text_report(df).collect()) == [(1, "", 0), (1, "", 0), (2, "x", 1)]
    assert html.main_text(df.withColumn("text", F.lit(5))).schema["text"].dataType.simpleString() == "string"
