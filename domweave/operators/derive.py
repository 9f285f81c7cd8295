"""Views of a page as columns over its array of elements: text, markdown, links, images, tables, forms, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from domweave.functions.urls import url_join_all
from domweave.operators.select import css_nodes
from domweave.sources.pages import children, last_wins, node_text, subtree


def _tagged(dom: Column, *tags: str) -> Column:
    return F.filter(dom, lambda n: n["tag"].isin(*tags))


def _with(nodes: Column, attribute: str) -> Column:
    return F.filter(nodes, lambda n: n["attrs"][attribute].isNotNull())


# of selected elements

def texts(dom: Column, nodes: Column) -> Column:
    """The text of each, empty ones too."""
    return F.transform(nodes, lambda n: node_text(dom, n))


def joined_text(dom: Column, nodes: Column) -> Column:
    """The texts that aren't empty, with spaces between."""
    return F.array_join(F.filter(texts(dom, nodes), lambda t: t != ""), " ")


def combined_text(dom: Column, nodes: Column) -> Column:
    """All texts with spaces between, empty ones too; for records."""
    return F.array_join(texts(dom, nodes), " ")


def attribute(nodes: Column, name: str) -> Column:
    """Of the first element; null without one."""
    return F.get(nodes, F.lit(0))["attrs"][name]


def attributes(nodes: Column, name: str) -> Column:
    """Of each element, null where one hasn't it."""
    return F.transform(nodes, lambda n: n["attrs"][name])


# of a page

def title(dom: Column) -> Column:
    """The text of the first title, empty without one."""
    return F.coalesce(node_text(dom, F.get(_tagged(dom, "title"), F.lit(0))), F.lit(""))


def page_text(dom: Column) -> Column:
    """The text of the first root and all below it."""
    return F.coalesce(node_text(dom, F.get(dom, F.lit(0))), F.lit(""))


def markdown(dom: Column) -> Column:
    """The first root's elements in document order, each written by its tag from its own trimmed text."""

    def written(n: Column) -> Column:
        text, tag, attrs = n["trimmed"], n["tag"], n["attrs"]
        some = text != ""
        heading = F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" "), text, F.lit("\n\n"))
        link = F.when(some, F.concat(F.lit("["), text, F.lit("]("), attrs["href"], F.lit(")"))).otherwise(F.concat(F.lit("<"), attrs["href"], F.lit(">")))
        image = F.concat(F.lit("!["), F.coalesce(attrs["alt"], F.lit("")), F.lit("]("), attrs["src"], F.lit(")"))
        return (
            F.when(tag.isin("h1", "h2", "h3", "h4", "h5", "h6"), F.when(some, heading).otherwise(""))
            .when((tag == "a") & attrs["href"].isNotNull(), link)
            .when(tag == "img", F.coalesce(image, F.lit("")))
            .when(tag == "br", "\n")
            .when(tag == "hr", "\n---\n")
            .when(tag.isin("p", "div", "li"), F.when(some, F.concat(F.lit("\n"), text, F.lit("\n"))).otherwise(""))
            .otherwise(text)
        )

    return F.coalesce(F.array_join(F.transform(subtree(dom, F.get(dom, F.lit(0))), written), ""), F.lit(""))


def links(dom: Column, url: Column) -> Column:
    return url_join_all(url, attributes(_with(_tagged(dom, "a"), "href"), "href"))


def scripts(dom: Column, url: Column) -> Column:
    return url_join_all(url, attributes(_with(_tagged(dom, "script"), "src"), "src"))


def styles(dom: Column, url: Column) -> Column:
    return url_join_all(url, attributes(_with(css_nodes(dom, "link[rel=stylesheet]"), "href"), "href"))


def images(dom: Column, url: Column) -> Column:
    """Structs (src, alt); alt is null where there is none."""
    found = _with(_tagged(dom, "img"), "src")
    pairs = F.arrays_zip(url_join_all(url, attributes(found, "src")).alias("src"), attributes(found, "alt").alias("alt"))
    return F.transform(pairs, lambda p: F.struct(p["src"].alias("src"), p["alt"].alias("alt")))


def tables(dom: Column) -> Column:
    """Structs (headers, rows), one for each table, those in tables too.

    Each element straight inside a thead gives one header, its whole text. Rows
    straight inside the table come next, the first of which is the headers if
    there are none yet; rows of a tbody or tfoot are always rows. Rows without
    cells don't count.
    """

    def cells(row: Column) -> Column:
        held = F.filter(children(dom, row), lambda c: c["tag"].isin("td", "th"))
        return F.transform(held, lambda c: node_text(dom, c))

    def table(t: Column) -> Column:
        inside = children(dom, t)
        in_heads = F.flatten(F.transform(F.filter(inside, lambda c: c["tag"] == "thead"), lambda h: children(dom, h)))
        headers = F.filter(F.transform(in_heads, lambda h: node_text(dom, h)), lambda x: x != "")

        def rows_of(c: Column) -> Column:
            # whether it may become the headers, and its cells
            own = F.array(F.struct(F.lit(True).alias("own"), cells(c).alias("cells")))
            lower = F.transform(F.filter(children(dom, c), lambda r: r["tag"] == "tr"), lambda r: F.struct(F.lit(False).alias("own"), cells(r).alias("cells")))
            return F.when(c["tag"] == "tr", own).otherwise(lower)

        groups = F.filter(inside, lambda c: c["tag"].isin("tr", "tbody", "tfoot"))
        rows = F.filter(F.flatten(F.transform(groups, rows_of)), lambda r: F.size(r["cells"]) > 0)
        first = F.when(F.size(headers) == 0, F.array_position(F.transform(rows, lambda r: r["own"]), True)).otherwise(0)
        top = F.when(first > 0, F.get(rows, (first - 1).cast("int"))["cells"]).otherwise(headers)
        rest = F.filter(rows, lambda r, i: i + 1 != first)
        return F.struct(top.alias("headers"), F.transform(rest, lambda r: r["cells"]).alias("rows"))

    return F.transform(_tagged(dom, "table"), table)


def forms(dom: Column) -> Column:
    """Structs (action, method, inputs): method is get where none is written, inputs are the names of the fields inside."""

    def form(f: Column) -> Column:
        fields = F.filter(subtree(dom, f), lambda n: n["tag"].isin("input", "textarea", "select") & n["attrs"]["name"].isNotNull())
        return F.struct(f["attrs"]["action"].alias("action"), F.coalesce(f["attrs"]["method"], F.lit("get")).alias("method"), attributes(fields, "name").alias("inputs"))

    return F.transform(_tagged(dom, "form"), form)


def metadata(dom: Column) -> Column:
    """A map of the title, the meta elements' contents by name or property (lower case, colons as underscores) and the charset; a description falls back to og_description."""

    def of_meta(n: Column) -> Column:
        attrs = n["attrs"]
        name = F.coalesce(attrs["name"], attrs["property"])
        named = F.struct(F.replace(F.lower(name), F.lit(":"), F.lit("_")).alias("key"), attrs["content"].alias("value"))
        charset = F.struct(F.lit("charset").alias("key"), attrs["charset"].alias("value"))
        return F.filter(F.array(named, charset), lambda e: e["key"].isNotNull() & e["value"].isNotNull())

    top = F.filter(F.array(F.struct(F.lit("title").alias("key"), title(dom).alias("value"))), lambda e: e["value"] != "")
    entries = F.concat(top, F.flatten(F.transform(_tagged(dom, "meta"), of_meta)))
    found = last_wins(entries)
    fallback = F.when(found["description"].isNull() & found["og_description"].isNotNull(), F.create_map(F.lit("description"), found["og_description"]))
    return F.map_concat(found, F.coalesce(fallback, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
