"""The selector language, compiled to column expressions over an array of elements.

Every selector becomes the array of the numbers of the elements it selects, in
document order, evaluated within the row: no join and no shuffle. A chain of
ancestors is a fold from the parent up whose state is the number of steps that
are still to be matched.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from domweave.errors import SelectorError
from domweave.sources.pages import ancestors, next_sibling

Test = Callable[[Column], Column]


def words(value: Column) -> Column:
    """What white space separates in a string."""
    return F.filter(F.split(value, r"(?U)\s+"), lambda w: w != "")


# CSS

@dataclass(frozen=True)
class Part:
    """One condition: kind is tag, class, id, or the operator of an attribute ('' where it need only exist)."""

    kind: str
    name: str = ""
    value: str = ""


_OPERATOR = re.compile(r"[~|^$*]=|=")


def _attribute(inner: str) -> Part | None:
    inner = inner.strip()
    m = _OPERATOR.search(inner)
    if m is None:
        return Part("", inner) if inner else None
    name, value = inner[: m.start()].strip(), inner[m.end() :].strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    return Part(m.group(), name, value) if name else None


_STEP = re.compile(r"(?P<mark>[.#])(?P<name>[^.#\[]*)|\[(?P<inner>[^\]]*)\]?|(?P<tag>[^.#\[]+)")


@lru_cache(maxsize=4096)
def parse_css(selector: str) -> tuple[tuple[Part, ...], ...]:
    """The groups of a selector, each the conditions of one element; between groups is "somewhere inside".

    White space separates groups wherever it stands. Combinators, commas, `*` and
    pseudo-classes have no meaning of their own and are read as names.
    """
    groups = []
    for word in selector.split():
        parts = []
        for m in _STEP.finditer(word):
            if m["mark"]:
                parts.append(Part("class" if m["mark"] == "." else "id", value=m["name"]))
            elif m["tag"]:
                parts.append(Part("tag", value=m["tag"]))
            elif part := _attribute(m["inner"]):
                parts.append(part)
        groups.append(tuple(parts))
    return tuple(groups)


def _part(node: Column, part: Part) -> Column:
    value = F.lit(part.value)
    if part.kind == "tag":
        return node["tag"] == F.lit(part.value.lower())
    if part.kind == "class":
        return F.array_contains(words(node["attrs"]["class"]), value)
    if part.kind == "id":
        return node["attrs"]["id"] == value
    held = node["attrs"][part.name]
    if part.kind == "":
        return held.isNotNull()
    if part.kind == "=":
        return held == value
    if part.kind == "~=":
        return F.array_contains(words(held), value)
    if part.kind == "|=":
        return (held == value) | held.startswith(part.value + "-")
    if part.kind == "^=":
        return held.startswith(part.value)
    if part.kind == "$=":
        return held.endswith(part.value)
    return held.contains(part.value)


def group_test(parts: tuple[Part, ...]) -> Test:
    """Whether a node meets all conditions, the cheap ones first; no condition is met by every node."""
    ordered = sorted(parts, key=lambda p: ("tag", "id").index(p.kind) if p.kind in ("tag", "id") else 2)

    def test(node: Column) -> Column:
        all_of = F.lit(True)
        for k, part in enumerate(ordered):
            one = F.coalesce(_part(node, part), F.lit(False))
            all_of = one if k == 0 else all_of & one
        return all_of

    return test


def _chain(dom: Column, node: Column, tests: list[Test], direct: list[bool]) -> Column:
    """Whether the node's ancestors, from the parent up, meet the tests from the last to the first.

    A test that isn't met passes on to the next ancestor, and where it is
    `direct` the chain fails.
    """

    def step(left: Column, above: Column) -> Column:
        out = left
        for k in range(len(tests)):
            missed = F.lit(-1) if direct[k] else F.lit(k + 1)
            out = F.when(left == k + 1, F.when(tests[k](above), F.lit(k)).otherwise(missed)).otherwise(out)
        return out

    return F.aggregate(ancestors(dom, node), F.lit(len(tests)), step) == 0


def _select(dom: Column, tests: list[Test], direct: list[bool]) -> Column:
    *above, leaf = tests

    def test(node: Column) -> Column:
        return leaf(node) & _chain(dom, node, above, direct) if above else leaf(node)

    return F.filter(dom, test)


def css_nodes(dom: Column, selector: str) -> Column:
    """The elements that a selector of compound steps and descendants selects; none for an empty one."""
    groups = parse_css(selector)
    if not groups:
        return F.filter(dom, lambda n: F.lit(False))
    return _select(dom, [group_test(g) for g in groups], [False] * (len(groups) - 1))


# XPath

@dataclass(frozen=True)
class Segment:
    """One step: `inside` tells that it was written after a double slash."""

    tag: str
    inside: bool
    attribute: str | None = None
    value: str = ""


@lru_cache(maxsize=4096)
def parse_xpath(path: str) -> tuple[Segment, ...]:
    """The steps of a path; a predicate counts only as `[@name='value']`, anything else in brackets is no condition."""
    out: list[Segment] = []
    if not path:
        return ()
    inside = path.startswith("//")
    rest = path[2:] if inside else path.removeprefix("/")
    for step in rest.split("/"):
        if not step:
            inside = True
            continue
        tag, bracket, tail = step.partition("[")
        name, value = None, ""
        if bracket and "]" in step:
            inner = tail.partition("]")[0]
            sides = inner[1:].split("=") if inner.startswith("@") else []
            if len(sides) == 2:
                name, value = sides[0].strip(), sides[1].strip().strip("'").strip('"')
        out.append(Segment(tag, inside, name, value))
        inside = False
    return tuple(out)


def segment_test(segment: Segment) -> Test:
    def test(node: Column) -> Column:
        named = F.lit(True) if segment.tag == "*" else node["tag"] == F.lit(segment.tag.lower())
        if segment.attribute is None:
            return named
        held = node["attrs"][segment.attribute]
        same = held == F.lit(segment.value)
        if segment.attribute == "class":
            same = same | F.array_contains(words(held), F.lit(segment.value))
        return named & F.coalesce(same, F.lit(False))

    return test


def xpath_nodes(dom: Column, path: str) -> Column:
    """The elements at the end of a path.

    Whether a step may be any ancestor or must be the next one up is told by its
    own slashes, not by those after it; the nearest that fits is taken, and the
    first step is not tied to the root.
    """
    segments = parse_xpath(path)
    if not segments:
        return F.filter(dom, lambda n: F.lit(False))
    return _select(dom, [segment_test(s) for s in segments], [not s.inside for s in segments[:-1]])


# regular expressions and text

_UNSUPPORTED = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|(?P<look>\(\?(?:=|!|<=|<!|>))", re.S)


@lru_cache(maxsize=4096)
def check_pattern(pattern: str) -> str:
    """The pattern for the JVM; look-around, atomic groups and references back are refused."""
    for m in _UNSUPPORTED.finditer(pattern):
        if m["look"] or m.group()[0] == "\\" and m.group()[1:2] in set("123456789k"):
            raise SelectorError(f"not supported in a pattern: {m.group()!r}")
    checked = "(?U)" + pattern.replace("(?P<", "(?<")
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(checked)
        except IllegalArgumentException as e:
            raise SelectorError(f"{pattern!r}: {e}") from e
    return checked


def _readable(node: Column) -> Column:
    return ~node["tag"].isin("script", "style")


def regex_nodes(dom: Column, pattern: str) -> Column:
    """The elements whose own text has a match."""
    checked = check_pattern(pattern)
    return F.filter(dom, lambda n: _readable(n) & n["text"].rlike(checked))


def text_nodes(dom: Column, text: str) -> Column:
    """The elements whose own text holds the string; none for an empty one."""
    if not text:
        return F.filter(dom, lambda n: F.lit(False))
    return F.filter(dom, lambda n: _readable(n) & n["text"].contains(text))


def _beside(dom: Column, hits: Column, place: Callable[[Column], Column]) -> Column:
    ids = F.filter(F.transform(hits, place), lambda i: i.isNotNull())
    return F.transform(ids, lambda i: F.get(dom, i))


def after_text_nodes(dom: Column, text: str) -> Column:
    """For each element that holds the string its next sibling, or else the next element, if there is one; in the hits' order, repeats kept."""
    following = lambda n: F.coalesce(next_sibling(dom, n), F.when(n["node_id"] + 1 < F.size(dom), n["node_id"] + 1))
    return _beside(dom, text_nodes(dom, text), following)


def before_text_nodes(dom: Column, text: str) -> Column:
    """As `after_text_nodes`, with the sibling or element before."""
    preceding = lambda n: F.coalesce(n["prev"], F.when(n["node_id"] > 0, n["node_id"] - 1))
    return _beside(dom, text_nodes(dom, text), preceding)


KINDS: dict[str, Callable[[Column, str], Column]] = {
    "css": css_nodes,
    "xpath": xpath_nodes,
    "regex": regex_nodes,
    "text": text_nodes,
    "text_anchor": text_nodes,
    "after_text": after_text_nodes,
    "before_text": before_text_nodes,
}


def select(dom: str | Column, selector: str, kind: str = "css") -> Column:
    """The array of elements that a selector selects; an unknown kind is CSS."""
    column = F.col(dom) if isinstance(dom, str) else dom
    return KINDS.get(kind, css_nodes)(column, selector)


def select_ids(dom: str | Column, selector: str, kind: str = "css") -> Column:
    return F.transform(select(dom, selector, kind), lambda n: n["node_id"])
