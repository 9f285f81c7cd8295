"""Selectors over small pages."""

import pytest
from pyspark.sql import functions as F

from domweave.errors import SelectorError
from domweave.operators.derive import attribute, attributes, combined_text, joined_text, texts
from domweave.operators.select import check_pattern, parse_css, parse_xpath, select, select_ids
from domweave.sources.pages import node_text, nodes, with_dom

SHOP = """<html><head><title>Corner store</title></head><body id="b"><div id="top" class="frame"><div id="lot-7" class="offer">
<h1 class="offer-name">Brass kettle</h1><div class="cost"><span class="amount">$41.50</span> <span class="unit">USD</span></div>
<p title="t" class="about">Two litres</p><button id="order" class="go">Order now</button></div>.</div></body></html>"""


@pytest.fixture(scope="module")
def ids(spark):
    def run(html, selector, kind="css"):
        df = with_dom(spark.createDataFrame([(html,)], "html string"))
        return df.select(select_ids("dom", selector, kind).alias("i")).first().i

    return run


@pytest.mark.parametrize(
    "kind, selector, expected",
    [
        ("css", "h1.offer-name", [6]), ("css", "span.amount", [8]), ("css", "div span", [8, 9]), ("css", "#top .cost SPAN", [8, 9]), ("css", "div > span", []), ("css", "*", []), ("css", "h1,p", []), ("css", "", []),
        ("css", "body div div div", [7]), ("css", "[]", list(range(12))), ("css", "html div[class^=off] [id$='der']", [11]),
        ("after_text", "$41.50", [9]), ("before_text", "USD", [8]), ("after_text", "USD", [10]), ("before_text", "$41.50", [7]), ("text", "", []), ("text", "Price", []), ("regex", r"\$\d+", [8]),
        ("xpath", "//div/span", [8, 9]), ("xpath", "//div[@class='cost']/span[@class='amount']", [8]), ("xpath", "", []), ("xpath", "//button[@id='order']", [11]), ("something", "h1", [6]),
    ],
)
def test_shop(ids, kind, selector, expected):
    assert ids(SHOP, selector, kind) == expected


LINKS = "<p><input disabled><a href='/one'>1</a><link rel='stylesheet'><a class='b far' href='/two2'>2</a></p>"


@pytest.mark.parametrize("selector, n", [("a[href]", 2), ("a[href='/one']", 1), ("link[rel='stylesheet']", 1), ("input[disabled]", 1), ("a[data-x]", 0), ("a.far[href]", 1), ("a[class~=b]", 1), ("a[href*='o']", 2), ('[href$="2"]', 1)])
def test_attributes(ids, selector, n):
    assert len(ids(LINKS, selector)) == n


@pytest.mark.parametrize("selector, n", [("[lang|=en]", 1), ("[lang^=en]", 1), ("[lang$=US]", 1), ("[lang*=n-U]", 1), ("[lang~=en]", 0)])
def test_operators(ids, selector, n):
    assert len(ids("<div lang='en-US'>", selector)) == n


@pytest.mark.parametrize(
    "html, path, n",
    [
        ("<div><p><span>s</span></p></div>", "//div/span", 1),  # a step's own slashes tell how far up it may be
        ("<html><body><span>s</span></body></html>", "/html//span", 0),
        ("<html><body><span>s</span></body></html>", "/span", 1),
        ("<a href=x>1</a><a>2</a>", "//a[@href]", 2),
        ("<a href=x>1</a><a>2</a>", "//a[@x='1' and @y='2']", 2),
        ("<div class='a b'><i>", "//div[@class='a']/*", 1),
    ],
)
def test_xpath_ways(ids, html, path, n):
    assert len(ids(html, path, "xpath")) == n


def test_very_deep(ids):
    html = "<section class=top>" + "<div>" * 400 + "<b>x</b>"
    assert ids(html, "section.top b") == [401]
    assert ids(html, "//section/b", "xpath") == [401]
    assert ids(html, "p b") == []


def test_repeated_hits_are_kept(ids):
    assert ids("<div><p>k <b>k</b></p><i>z</i></div>", "k", "after_text") == [3, 3]


def test_refused_patterns(spark):
    for pattern in (r"a(?=b)", r"(?<!a)b", r"(a)\1", "("):
        with pytest.raises(SelectorError):
            check_pattern(pattern)
    assert check_pattern(r"[(?=]\\1").endswith(r"[(?=]\\1")
    df = with_dom(spark.createDataFrame([("<p>Café</p>",)], "html string"))
    assert df.select(F.size(select("dom", r"^\w+$", "regex"))).first()[0] == 1


def test_texts_and_attributes(spark):
    df = with_dom(spark.createDataFrame([("<p>a <b>x</b> c</p><p></p><a href=u>l</a>",)], "html string"))
    p = select("dom", "p")
    dom = F.col("dom")
    row = df.select(texts(dom, p).alias("t"), joined_text(dom, p).alias("j"), combined_text(dom, p).alias("c"), attribute(select("dom", "a"), "href").alias("h"), attributes(dom, "href").alias("hs"), node_text(dom, F.get(dom, F.lit(0))).alias("n")).first()
    assert (row.t, row.j, row.c, row.h, row.hs, row.n) == (["a  c x", ""], "a  c x", "a  c x ", "u", [None, None, None, "u"], "a  c x")


def test_null_empty_and_binary(spark):
    df = with_dom(spark.createDataFrame([(None,), (b"",), (b"<div>Caf\xe9</div>",)], "html binary"))
    assert [r.dom if r.dom is None else [n.text for n in r.dom] for r in df.collect()] == [None, [], ["Caf�"]]
    assert nodes(df).count() == 1


def test_parsers():
    assert parse_css("a[x='b c']") and len(parse_css("a b")) == 2
    assert [s.tag for s in parse_xpath("//a[@h='x/y']")] == ["a", "y']"]
