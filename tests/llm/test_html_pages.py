"""Extraction on the driver's pages against a parser of the standard library, and pages that once lost text."""

import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from potamos.llm import common, html_extract

from .test_whole_job import seen


class ArticleBlocks(HTMLParser):
    """Text of the leaf blocks inside <article>: the truth for pages whose layout is known."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.text = 0, [], []

    def flush(self):
        joined = " ".join("".join(self.text).split())
        if joined:
            self.blocks.append(joined)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag == "br" and self.inside:
            self.text.append(" ")
        elif tag not in ("b", "a", "i", "em", "span"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i", "em", "span"):
            self.flush()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside:
            self.text.append(data)


def test_all_pages_of_the_driver(spark):
    for sf in ("sf0.001", "sf0.01"):
        pages = common.table(spark, f"/root/testdata/{sf}", "pages")
        got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
        right = 0
        for r in pages.collect():
            parser = ArticleBlocks()
            parser.feed(r.html or "")
            parser.close()
            right += got[r.page_id] == "\n\n".join(parser.blocks)
        assert right >= 0.99 * len(got) and len(got) >= 50, right / len(got)


def test_nothing_swallows_the_rest_of_a_page():
    assert seen("<p hidden>note<p>Article one.<p>two") == ["Article one.", "two"]
    assert seen('<ul><li style="display:none">x<li>y</ul><article>text</article>') == ["y", "text"]
    assert seen("<noscript>on<p>Article one.</p><p>two</p>") == ["Article one.", "two"]
    for tag in ("noscript", "template", "svg", "object", "video", "iframe", "canvas", "title"):
        assert seen(f"<div><{tag}>gone</div><p>Article <b>one</b>.</p><{tag}>x</{tag}><p>two</p>")[-1] == "two"
    assert seen("<noscript>no<b>x</b></noscript><p>one</p><svg><title>t</title><g>x</g></svg><p>two") == ["one", "two"]
    assert seen("<p>one<script>if (a<b) '<p>'</script> two</p><style>p{}") == ["one two"]


def test_formulas_stay_in_their_paragraph():
    page = "<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> hold.</p>"
    assert seen(page) == ["Let x=2 hold."]


@pytest.mark.parametrize("unit", ["<p hidden>", "<noscript>", "<svg>", "<script>", "<li style='display:none'>", "<a ", "<!--", "<div hidden><p>x", "&amp;<b>", "<![CDATA["])
def test_long_odd_pages(unit):
    began = time.time()
    html_extract.blocks(unit * 5_000)
    assert time.time() - began < 30


def test_rows_and_names(spark):
    body = "<article><h1>Head</h1>" + "<p>" + "A sentence of the article. " * 20_000 + "</p></article>"
    rows = spark.createDataFrame([(1, "u", body), (1, "u", body), (None, None, None), (3, "w", ""), (4, "x", "<nav><a href=/>Home</a></nav>")], "page_id long, url string, html string")
    for c in ("text", "n_chars", "id"):
        rows = rows.withColumn(c, F.lit(c))
    got = html_extract.extract(rows).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 540_005), (1, 540_005), (3, 0), (4, 0)]
    assert all(r.n_chars == len(r.text) for r in got) and html_extract.extract(rows.limit(0)).count() == 0
