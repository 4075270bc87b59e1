"""Main text against the standard library's parser on every page of a table, markup that isn't closed, and long pages."""

from __future__ import annotations

import re
import time
from html.parser import HTMLParser

import pytest

from claimlens.llm import html_extract
from claimlens.llm.queries import QUERIES
from conftest import SF_CHECK


class Article(HTMLParser):
    """Blocks of a page's article elements: what lies between tags that aren't inline."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.found, self.now = 0, [], []

    def cut(self):
        text = re.sub(r"\s+", " ", "".join(self.now)).strip()
        self.now = []
        if text:
            self.found.append(text)

    def handle_starttag(self, tag, attrs):
        if tag not in html_extract.INLINE or tag == "br":
            self.cut()
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag not in html_extract.INLINE:
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now.append(data)


def test_query_against_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op4_html_extract"](spark, SF_CHECK).collect()}
    assert len(got) == len(pages)
    for p in pages:
        parser = Article()
        parser.feed(p.html)
        parser.close()
        parser.cut()
        assert got[p.page_id].text == "\n".join(parser.found), p.page_id
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


@pytest.mark.parametrize("page, want", [
    ('<article><p title="abc>Hello world</p><p>two</p>', "Hello world\ntwo"),
    ("<article><p title='abc>Hello \"world\"</p><p>two</p>", 'Hello "world"\ntwo'),
    ('<article><p title="a > b">Hello</p><a href=it\'s>world</a>', "Hello\nworld"),
    ("<article><p>one<div hidden>two</div><div class='share-buttons'>three</div><p class=copyright>four</article>", "one\ntwo\nthree\nfour"),
    ("<article><p>one</p><div class='comments'>no</div><nav>no</nav><form>no</form><div class='cookie-notice'>no</div><div class=ad>no</div></article>", "one"),
    ("<article><p>one</p></article><div class='related'>no</div>", "one"),
    ("<article><p>a</b>b<b>c<p>d</b>e</article>", "ab c".replace(" ", "") + "\nde"),
    ("<article><b>x<p>y</b>z</p></article>", "x\nyz"),
    ("<article>a<!-- b > c -->d<![CDATA[ e > f ]]>g<!x>h<?y?>i</article>", "adghi"),
    ("<article>a < b <1 <", "a < b <1 <"),
])
def test_odd_markup(page, want):
    assert html_extract.settled_text(page) == want


@pytest.mark.parametrize("piece", ["<a ", "<a href='", '<div class="x" ', "<div></b>", "<b><div></b>", "<p><b>", "</div>", "<!--", "<", "&", "<b><div/>", "<script>",
                                   "<i></i><p", "<li><b>", "<a title=\">\" "])
def test_a_megabyte_of_odd_tags_takes_seconds(piece):
    page = "<article>text " + piece * (1_000_000 // len(piece)) + '"'
    begin = time.perf_counter()
    html_extract.settled_text(page)
    assert time.perf_counter() - begin < 10
