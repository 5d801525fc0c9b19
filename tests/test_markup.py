"""The tokenizer of link extraction: markup rules, and time in proportion to the page."""

import time

import pytest

from linkweave.functions.markup import anchor_hrefs, decode_references
from linkweave.operators import ingest as IN

N = 100_000


@pytest.mark.parametrize(
    "page",
    [
        "<a x=" + "/q=" * (N // 3) + ">", "<a " + "x " * (N // 2) + "href=/k>", "<a " + 'x="1" ' * (N // 6) + "href=/k>", "<" * N, "<a " * (N // 3),
        "<div>" * 20_000 + "</b>" * 20_000 + "</div>" * 20_000, "<!--" * (N // 4), "<script>" * (N // 8), "</" * (N // 2), "<a " + "=" * N + ">", "<a href=" + "&amp" * (N // 4) + ">", "<a" + " " * N + "x",
    ],
)
def test_hostile_markup_takes_linear_time(page):
    for scope in (None, "x"):
        began = time.process_time()
        list(anchor_hrefs(page, scope))
        assert time.process_time() - began < 1.0


def test_attribute_rules():
    assert list(anchor_hrefs('<a href="1" href="2">')) == ["1"]
    assert list(anchor_hrefs("<a href>x</a><a href=>y</a><a href=''>")) == ["", "", ""]
    assert list(anchor_hrefs("<A\nHREF = '/x'\t>")) == ["/x"]
    assert list(anchor_hrefs('<a title="a > b" href=/y/>')) == ["/y/"]
    assert list(anchor_hrefs('<a href="/never ends')) == []
    assert list(anchor_hrefs("1 < 2 <a href=/z>")) == ["/z"]
    assert list(anchor_hrefs("<abbr href=/no><a/href=/s>")) == ["/s"]
    assert decode_references("&copy=2&eacute;&#233;&#xE9;") == "&copy=2ééé"


def test_scope_follows_nesting():
    page = '<p><a href=/0></p><div id=s><b><a href=/1></b></i><br><div><a href=/2></div><a href=/3></div><a href=/4><div id=s><a href=/5>'
    assert list(anchor_hrefs(page, "s")) == ["/1", "/2", "/3", "/5"]
    assert list(anchor_hrefs(page)) == [f"/{k}" for k in range(6)]
    assert list(anchor_hrefs("<div id=s><!-- </div> --><a href=/1><script></div></script><a href=/2>", "s")) == ["/1", "/2"]


def test_one_hostile_page_does_not_stop_a_job(spark):
    pages = spark.createDataFrame([(1, "<a " + "x=1 " * 20_000 + "href=/wiki/Far>"), (2, None), (3, ""), (None, "<a href=/wiki/Id>")], "page_id long, html string")
    assert sorted(map(str, (r.target_title for r in IN.extract_links(pages).collect()))) == ["Far", "Id"]
