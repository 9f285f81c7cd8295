"""HTML to a flat list of elements in document order, without Spark.

One scan from left to right over the source with an explicit stack. No element
is implied: `<p>a<p>b` nests, a stray end tag is nothing, text outside of any
element is dropped, and entities stay as they are written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Elements that hold nothing, whether they are written self-closed or not.
LEAVES = frozenset("wbr track source param meta link input img hr embed col br base area".split()) | frozenset("circle ellipse image line path polygon polyline rect stop use".split())
#: Elements whose content is one text up to their own end tag.
VERBATIM = frozenset("script style xmp iframe noembed noframes title textarea".split())
#: Elements inside which `<x/>` is a leaf.
FOREIGN = frozenset(("svg", "math"))
#: Elements with longer chains of ancestors have none stored (see `sources.pages.ancestors`).
DEEPEST = 256
#: White space in Unicode's sense.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_MARKUP = re.compile(r"<(?:(?P<tag>/?[a-zA-Z][^ \t\n\f\r/>]*)|(?P<comment>!--)|(?P<bogus>[!?/]))")
_ATTRIBUTE = re.compile(r"""[ \t\n\f\r/]*(?:(>)|(=?[^ \t\n\f\r/>=]+|=)(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:"([^"]*)"|'([^']*)'|((?!["'])[^ \t\n\f\r>]*)))?)""")
_ASSIGNED = re.compile(r"[ \t\n\f\r]*=")
_COMMENT_END = re.compile(r"--!?>")
_VERBATIM_END = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])", re.I) for t in VERBATIM}


@dataclass
class Elements:
    """Columns of the elements; the position in them is the element's number."""

    parent: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    previous: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    ancestors: list[list[int] | None] = field(default_factory=list)


def _attributes(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes from `at` on, where the tag ends (-1 if it doesn't), and whether it closes itself."""
    found: dict[str, str] = {}
    if html.startswith(">", at):
        return found, at + 1, False
    while m := _ATTRIBUTE.match(html, at):
        if m[1]:
            return found, m.end(), html[m.end() - 2] == "/" and m.end() - 2 >= at
        at = m.end()
        value = m[3] if m[3] is not None else m[4] if m[4] is not None else m[5]
        if value is None and _ASSIGNED.match(html, at):
            break  # a quote that nothing closes
        found[m[2].lower()] = value or ""
    return found, -1, False


def parse(html: str | None) -> Elements:
    """The elements of a page; none for null or empty source."""
    out = Elements()
    if not html:
        return out
    stack: list[int] = []
    open_tags: dict[str, int] = {}
    held: list[list[str]] = []  # the texts of each element
    youngest: list[int] = []  # the last child of each element
    children: list[int] = []
    foreign = 0
    parent, last, tags = out.parent, out.last, out.tag

    def close(k: int) -> None:
        """Pops the stack down to length k."""
        nonlocal foreign
        end = len(tags) - 1
        for e in stack[k:]:
            last[e] = end
            open_tags[tags[e]] -= 1
            foreign -= tags[e] in FOREIGN
        del stack[k:]

    at, size = 0, len(html)
    search = _MARKUP.search
    while at < size:
        m = search(html, at)
        start = m.start() if m else size
        if start > at and stack:
            held[stack[-1]].append(html[at:start])
        if m is None:
            break
        at, tag = m.end(), m["tag"]
        if tag is None:
            if m["comment"]:
                if html.startswith((">", "->"), at):
                    at = html.index(">", at) + 1
                    continue
                end = _COMMENT_END.search(html, at)
                at = end.end() if end else size
            else:
                end = html.find(">", at)
                at = end + 1 if end >= 0 else size
            continue
        attributes, end, closed = _attributes(html, at)
        if end < 0:
            break  # a tag that is cut off
        at, tag = end, tag.lower()
        if tag[0] == "/":
            tag = tag[1:]
            if open_tags.get(tag):
                k = len(stack) - 1
                while tags[stack[k]] != tag:
                    k -= 1
                close(k)
            continue
        number, up = len(tags), stack[-1] if stack else -1
        parent.append(up)
        last.append(number)
        out.depth.append(len(stack))
        tags.append(tag)
        out.attributes.append(attributes)
        out.ancestors.append(stack[::-1] if len(stack) <= DEEPEST else None)
        out.place.append(children[up] if stack else 0)
        out.previous.append(youngest[up] if stack else -1)
        if stack:
            youngest[up] = number
            children[up] += 1
        held.append([])
        youngest.append(-1)
        children.append(0)
        if tag in LEAVES or closed and (foreign or tag in FOREIGN):
            continue
        stack.append(number)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        foreign += tag in FOREIGN
        if tag == "plaintext":
            held[number].append(html[at:])
            break
        if tag in VERBATIM and not foreign:
            end = _VERBATIM_END[tag].search(html, at)
            stop = end.start() if end else size
            held[number].append(html[at:stop])
            at = stop
    close(0)
    out.text = ["" if t in ("script", "style") else "".join(h) for t, h in zip(tags, held)]
    return out
