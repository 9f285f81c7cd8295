"""The kernel that turns source into elements, rule by rule."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from domweave.sources import pages
from domweave.sources.tokens import parse


def shape(html):
    p = parse(html)
    return list(zip(p.tag, p.parent, p.text))


@pytest.mark.parametrize(
    "html, expected",
    [
        ("", []),
        (None, []),
        ("<div><p>Good day</p></div>", [("div", -1, ""), ("p", 0, "Good day")]),
        ("<div><p>Some <span>Nested</div><i>x", [("div", -1, ""), ("p", 0, "Some "), ("span", 1, "Nested"), ("i", -1, "x")]),
        ("<p>a<p>b", [("p", -1, "a"), ("p", 0, "b")]),
        ("<div>a</span>b</div>", [("div", -1, "ab")]),
        ("<div>x<br>y</div>", [("div", -1, "xy"), ("br", 0, "")]),
        ("text<div>a</div>tail", [("div", -1, "a")]),
        ('<div>a<script>var t="</p>";</script><style>p{}</style>b</div>', [("div", -1, "ab"), ("script", 0, ""), ("style", 0, "")]),
        ("<p>A &amp; B</p>", [("p", -1, "A &amp; B")]),
        ("<svg><path d='M'/><circle r='4'/><g/></svg>", [("svg", -1, ""), ("path", 0, ""), ("circle", 0, ""), ("g", 0, "")]),
        ("<title>a<b>c</title><i>", [("title", -1, "a<b>c"), ("i", -1, "")]),
        ("<!DOCTYPE html><!-- unclosed <div>", []),
        ("<!--> <b>x</b>", [("b", -1, "x")]),
        ("<p>1 < 2 <3</p>", [("p", -1, "1 < 2 <3")]),
        ("<DIV>\U0001f680</DIV>", [("div", -1, "\U0001f680")]),
        ("<p>a <b", [("p", -1, "a ")]),
        ("<p>a <b c='", [("p", -1, "a ")]),
        ("<plaintext><b>x", [("plaintext", -1, "<b>x")]),
    ],
)
def test_shapes(html, expected):
    assert shape(html) == expected


def test_attributes():
    p = parse("<a title=it's HREF = \"/x?a=1&amp;b\" data-x='' disabled href2=u/>k</a>")
    assert p.attributes == [{"title": "it's", "href": "/x?a=1&amp;b", "data-x": "", "disabled": "", "href2": "u/"}]
    assert parse("<div id=a id=b>").attributes == [{"id": "b"}]


def test_deep_nesting():
    p = parse("<div>" * 3000 + "leaf")
    assert len(p.tag) == 3000 and p.depth[-1] == 2999 and p.text[-1] == "leaf" and set(p.last) == {2999}
    assert p.ancestors[256] == list(range(255, -1, -1)) and p.ancestors[257] is None


_PIECES = st.lists(st.sampled_from(["<div>", "</div>", "<p class='a'>", "</p>", "text", "<br>", "<b/>", "</x>", "<!-- c -->", "<script>", "</script>", "<", "&lt;", "<svg>", "</svg>", "<g/>"]), max_size=40)


@settings(max_examples=200, deadline=None)
@given(_PIECES)
def test_document_order(pieces):
    p = parse("".join(pieces))
    for k, (up, last, depth) in enumerate(zip(p.parent, p.last, p.depth)):
        assert up < k <= last < len(p.tag)
        assert depth == (0 if up < 0 else p.depth[up] + 1)
        assert p.ancestors[k] == ([] if up < 0 else [up, *p.ancestors[up]])
        # those below it are the numbers up to its last
        assert [j for j in range(len(p.tag)) if k in (p.ancestors[j] or [])] == list(range(k + 1, last + 1))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp!-='\" &é", max_size=60))
def test_anything_parses(text):
    parse(text)


def test_a_batch_is_parsed_in_small_parts():
    sources = pa.array(["<p>x</p>" * 400, None, "", "<a href=u>" * 50_000, *["<p>a<b c=d>e</b></p>"] * 60_000])
    found = list(pages.dom_arrays(iter([sources[:0], sources])))
    assert pa.concat_arrays(found).equals(pages.dom_array(sources))
    sizes = iter([0 if x is None else len(x) for x in sources.to_pylist()])
    held = [[next(sizes) for _ in range(len(part))] for part in found]
    assert len(held) > 4 and all(len(x) == 1 or sum(x) <= pages.PART_BYTES for x in held)
