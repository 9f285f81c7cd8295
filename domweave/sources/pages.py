"""Pages as a table of elements: the one crossing into Python, and everything after it as columns.

`with_dom` adds an array of elements to each page. An element is a struct
(node_id, parent, last_desc, depth, sib_pos, prev, tag, text, trimmed, attrs,
anc): node_id counts in document order, so the elements below one are those
with numbers up to its last_desc; text is its own text, trimmed the same without
white space around it; prev is the sibling before it; anc are its ancestors'
numbers from the parent up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.sources.tokens import SPACE, parse

DOM_TYPE = "array<struct<node_id:int,parent:int,last_desc:int,depth:int,sib_pos:int,prev:int,tag:string,text:string,trimmed:string,attrs:map<string,string>,anc:array<int>>>"

#: Bytes of source, or elements, that Python takes up at once; a single page may have more.
PART_BYTES, PART_NODES = 1 << 18, 1 << 12


def parts(sizes: pa.Array, most: int) -> Iterator[slice]:
    """Stretches of a batch whose sizes make no more than `most`, or of one row. A batch's memory then doesn't grow with its rows."""
    at, held = 0, 0
    for k, size in enumerate(sizes.to_pylist()):
        if k > at and held + (size or 0) > most:
            yield slice(at, k)
            at, held = k, 0
        # rows without anything count too
        held += (size or 0) + 1
    if at < len(sizes):
        yield slice(at, len(sizes))


def _lists(lengths: list[int]) -> pa.Array:
    total, out = 0, [0]
    for n in lengths:
        total += n
        out.append(total)
    return pa.array(out, pa.int32())


def dom_array(sources: pa.Array) -> pa.Array:
    """The elements of each source, built column by column; null where the source is null."""
    pages = [None if s is None else parse(s.decode("utf-8", "replace") if isinstance(s, bytes) else s) for s in sources.to_pylist()]
    some = [p for p in pages if p is not None]

    def flat(name: str) -> list:
        return [x for p in some for x in getattr(p, name)]

    def or_null(name: str) -> pa.Array:
        return pa.array([None if x < 0 else x for x in flat(name)], pa.int32())

    text, attributes, anc = flat("text"), flat("attributes"), flat("ancestors")
    keys = pa.array([k for a in attributes for k in a], pa.string())
    values = pa.array([v for a in attributes for v in a.values()], pa.string())
    fields = {
        "node_id": pa.array([i for p in some for i in range(len(p.tag))], pa.int32()),
        "parent": or_null("parent"),
        "last_desc": pa.array(flat("last"), pa.int32()),
        "depth": pa.array(flat("depth"), pa.int32()),
        "sib_pos": pa.array(flat("place"), pa.int32()),
        "prev": or_null("previous"),
        "tag": pa.array(flat("tag"), pa.string()),
        "text": pa.array(text, pa.string()),
        "trimmed": pa.array([t.strip(SPACE) for t in text], pa.string()),
        "attrs": pa.MapArray.from_arrays(_lists([len(a) for a in attributes]), keys, values),
        "anc": pa.array(anc, pa.list_(pa.int32())),
    }
    nodes = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    out = pa.ListArray.from_arrays(_lists([0 if p is None else len(p.tag) for p in pages]), nodes)
    if len(some) == len(pages):
        return out
    return pa.ListArray.from_arrays(out.offsets, out.values, mask=pa.array([p is None for p in pages]))


def dom_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """`dom_array` of each batch, some pages at a time."""
    for sources in batches:
        for part in parts(pc.binary_length(sources), PART_BYTES):
            yield dom_array(sources[part])


def parse_column(html: str | Column) -> Column:
    """The column of elements of a column of source (string, or binary in UTF-8; bytes that aren't become U+FFFD).

    The expression counts as not deterministic, so that the optimiser never
    duplicates it; rows should be filtered before it.
    """
    kernel = F.arrow_udf(dom_arrays, DOM_TYPE).asNondeterministic()
    return kernel(F.col(html) if isinstance(html, str) else html)


def with_dom(pages: DataFrame, html: str = "html", dom: str = "dom") -> DataFrame:
    return pages.withColumn(dom, parse_column(html))


def nodes(pages: DataFrame, dom: str = "dom") -> DataFrame:
    """One row for each element, with the other columns of its page before the element's."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c != dom]
    return pages.select(*kept, F.explode(dom).alias("__node")).select(*kept, "__node.*")


def ancestors(dom: Column, node: Column) -> Column:
    """The elements that a node is in, from its parent up."""
    listed = F.transform(node["anc"], lambda i: F.get(dom, i))
    # very deep ones have none stored: an ancestor's range reaches the node
    found = F.reverse(F.filter(F.slice(dom, F.lit(1), node["node_id"]), lambda a: a["last_desc"] >= node["node_id"]))
    return F.when(node["anc"].isNotNull(), listed).otherwise(found)


def subtree(dom: Column, node: Column) -> Column:
    """The node and everything below it, in document order."""
    return F.slice(dom, node["node_id"] + 1, node["last_desc"] - node["node_id"] + 1)


def children(dom: Column, node: Column) -> Column:
    below = F.slice(dom, node["node_id"] + 2, node["last_desc"] - node["node_id"])
    return F.filter(below, lambda c: c["parent"] == node["node_id"])


def siblings(dom: Column, node: Column) -> Column:
    """All others under the node's parent; none for a root."""
    beside = F.filter(children(dom, F.get(dom, node["parent"])), lambda c: c["node_id"] != node["node_id"])
    return F.coalesce(beside, F.filter(dom, lambda c: F.lit(False)))


def next_sibling(dom: Column, node: Column) -> Column:
    """Its number, null at the end and for roots: the first number beyond the node's range, if the parent is the same."""
    after = F.get(dom, node["last_desc"] + 1)
    return F.when(after["parent"] == node["parent"], after["node_id"])


def node_text(dom: Column, node: Column) -> Column:
    """The trimmed texts of the node and all below it that aren't empty, in document order, with spaces between."""
    return F.array_join(F.filter(F.transform(subtree(dom, node), lambda n: n["trimmed"]), lambda t: t != ""), " ")


def snippet(node: Column) -> Column:
    return F.concat(F.lit("<"), node["tag"], F.lit(">"))


# responses

def cookie_map(headers: str | Column) -> Column:
    """An array of Set-Cookie values as a map: what comes before the first semicolon, cut at the first equals sign."""
    column = F.col(headers) if isinstance(headers, str) else headers
    pair = F.transform(column, lambda h: F.split(F.split(h, ";", 2)[0], "=", 2))
    named = F.filter(pair, lambda p: F.size(p) == 2)
    entries = F.transform(named, lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value")))
    return last_wins(entries)


def last_wins(entries: Column) -> Column:
    """A map of an array of (key, value); of equal keys the last holds."""
    numbered = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i")))
    final = F.filter(numbered, lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(F.transform(final, lambda e: F.struct(e["key"], e["value"])))


def charset(content_type: str | Column) -> Column:
    """The charset that a Content-Type names, utf-8 without one."""
    column = F.col(content_type) if isinstance(content_type, str) else content_type
    named = F.trim(F.regexp_extract(column, "(?s)charset=(.*)$", 1))
    return F.when(named != "", named).otherwise("utf-8")


def polite_schedule(requests: DataFrame, per_second: float, host: str = "host", order: str = "url") -> DataFrame:
    """Adds `start_s`, the second at which each request may go: one at a time for each host, `per_second` of them; 0 for all without a limit."""
    from pyspark.sql import Window

    if per_second <= 0:
        return requests.withColumn("start_s", F.lit(0.0))
    turn = F.row_number().over(Window.partitionBy(host).orderBy(order)) - 1
    return requests.withColumn("start_s", turn / F.lit(float(per_second)))
