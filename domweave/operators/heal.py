"""Selectors that mend themselves: fingerprints of what they selected, and the element most like one.

A selector that still selects something is only looked up. Scores are computed
for the pages where it doesn't and for which a fingerprint is stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domweave.errors import MatchError
from domweave.functions.similarity import WEIGHTS, ancestor_score, attribute_similarity, depth_score, jaccard, jaro_winkler, most_alike, tag_score
from domweave.operators.select import select, words
from domweave.sources.pages import PART_NODES, ancestors, node_text, parts, snippet, with_dom

#: A candidate must score more than this.
THRESHOLD = 0.5


def _named(node: Column, attribute: str) -> Column:
    return F.coalesce(node["attrs"][attribute], F.lit(""))


def class_list(attrs: Column) -> Column:
    return F.coalesce(words(attrs["class"]), F.array().cast("array<string>"))


def ancestor_path(dom: Column, node: Column) -> Column:
    above = ancestors(dom, node)
    return F.transform(above, lambda a: F.struct(a["tag"].alias("tag"), _named(a, "class").alias("class"), _named(a, "id").alias("id"), a["depth"].alias("depth")))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(dom: Column, node: Column) -> Column:
    """What is remembered of an element, as a struct; null for a null element."""

    def known(n: Column, v: Column) -> Column:
        up, text, path, classes = (v[k] for k in ("up", "text", "path", "classes"))
        return F.struct(
            n["tag"].alias("tag"),
            text.alias("text"),
            snippet(n).alias("html_snippet"),
            n["depth"].alias("depth"),
            n["sib_pos"].alias("sibling_index"),
            F.coalesce(up["tag"], F.lit("")).alias("parent_tag"),
            _named(up, "class").alias("parent_class"),
            _named(up, "id").alias("parent_id"),
            n["attrs"].alias("attributes"),
            classes.alias("class_list"),
            n["attrs"]["id"].alias("id"),
            path.alias("ancestor_path"),
            F.xxhash64(n["tag"], text, n["depth"], classes, F.coalesce(n["attrs"]["id"], F.lit("")), path, n["sib_pos"]).alias("hash"),
        )

    def of(n: Column) -> Column:
        views = F.struct(F.get(dom, n["parent"]).alias("up"), node_text(dom, n).alias("text"), ancestor_path(dom, n).alias("path"), class_list(n["attrs"]).alias("classes"))
        return F.when(n["node_id"].isNotNull(), once(views, lambda v: known(n, v)))

    return once(node, of)


def capture(pages: DataFrame, selectors: Mapping[str, str] | list[str], url: str = "url", dom: str = "dom") -> DataFrame:
    """(url, selector_used, fields of the fingerprint, captured_at, similarity_score): of the first element of each selector on each page."""
    names = list(selectors)
    first = F.array(*[F.struct(F.lit(s).alias("selector_used"), fingerprint(F.col(dom), F.get(select(dom, s), F.lit(0))).alias("f")) for s in names])
    rows = pages.select(F.col(url).alias("url"), F.explode(first).alias("__s")).where("__s.f IS NOT NULL")
    return rows.select("url", "__s.selector_used", "__s.f.*", F.current_timestamp().alias("captured_at"), F.lit(1.0).alias("similarity_score"))


def _newest(fingerprints: DataFrame, *keys: str) -> DataFrame:
    rank = "__rank".ljust(max(map(len, fingerprints.columns)) + 1, "_")
    w = Window.partitionBy(*keys).orderBy(F.desc("captured_at"), F.desc("hash"))
    # a window, as what isn't read later needn't be carried through it
    return fingerprints.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def latest(fingerprints: DataFrame) -> DataFrame:
    """Of each (url, selector_used) the one captured last; of several at once the one with the greatest hash."""
    kept = [c for c in fingerprints.columns if c not in ("url", "selector_used")]
    return _newest(fingerprints, "url", "selector_used").select("url", "selector_used", *[F.col(f"`{c}`") for c in kept])


class FingerprintStore:
    """Fingerprints in a folder of Parquet files: writing appends, reading takes the latest of each key."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, fingerprints: DataFrame) -> None:
        fingerprints.withColumn("deleted", F.lit(False)).write.mode("append").parquet(self.path)

    def scan(self) -> DataFrame:
        return latest(self.spark.read.parquet(self.path)).where("NOT deleted").drop("deleted")

    def known(self) -> DataFrame:
        """As `scan`, but empty where nothing was stored yet."""
        try:
            return self.scan()
        except AnalysisException:
            empty = with_dom(self.spark.createDataFrame([], "url string, html string"))
            return capture(empty, ["*"])

    def get(self, url: str, selector: str) -> DataFrame:
        found = self.spark.read.parquet(self.path).where((F.col("url") == url) & (F.col("selector_used") == selector))
        return latest(found).where("NOT deleted").drop("deleted")

    def delete(self, url: str, selector: str, later: bool = False) -> None:
        """Marks the key as deleted as of now, or, where what is stored may be from a clock that is ahead, of just after it."""
        after = F.expr("captured_at + INTERVAL 1 MICROSECOND")
        gone = self.get(url, selector).withColumn("captured_at", F.greatest(F.current_timestamp(), after) if later else F.current_timestamp())
        gone.withColumn("deleted", F.lit(True)).write.mode("append").parquet(self.path)

    def compact(self, path: str) -> FingerprintStore:
        """A store at another path with the latest alone."""
        other = FingerprintStore(self.spark, path)
        other.put(self.scan())
        return other


_STORED = ("tag", "text", "depth", "attributes", "class_list", "ancestor_path")
_FOUND = "node_id int, text string, total double"


def attach(pages: DataFrame, fingerprints: DataFrame, selectors: Sequence[str], url: str = "url") -> DataFrame:
    """The pages with `__stored`: the latest fingerprint of each of the selectors under the page's url. Best done before pages are parsed."""
    names = list(dict.fromkeys(selectors))
    # null urls meet, too, and one shuffle and sort by these two serves what follows
    same = lambda c: {"value": F.coalesce(c, F.lit("")), "none": c.isNull()}
    by = ["__f_value", "__f_none"]
    rows = fingerprints.where(F.col("selector_used").isin(*names)).select("selector_used", F.struct(*_STORED).alias("__f"), "captured_at", "hash", *[v.alias(f"__f_{k}") for k, v in same(F.col("url")).items()])
    newest = _newest(rows.repartition(*by), *by, "selector_used")
    found = newest.groupBy(*by).agg(*[F.first(F.when(F.col("selector_used") == s, F.col("__f")), ignorenulls=True).alias(f"__f_{k}") for k, s in enumerate(names)])
    entries = F.filter(F.array(*[F.struct(F.lit(s).alias("key"), F.col(f"__f_{k}").alias("value")) for k, s in enumerate(names)]), lambda e: e["value"].isNotNull())
    by_url = found.select(*by, F.map_from_entries(entries).alias("__stored"))
    on = [v == F.col(f"__f_{k}") for k, v in same(F.col(url)).items()]
    return pages.join(by_url.hint("merge"), on, "left").drop(*by)


def _plain_scores(nodes: Column, stored: Column, weights: Mapping[str, float]) -> Column:
    """Of each element the weighted sum of the four scores that columns can express."""

    def one(n: Column) -> Column:
        parts = {"class": jaccard(class_list(n["attrs"]), stored["class_list"]), "attribute": attribute_similarity(n["attrs"], stored["attributes"]), "tag": tag_score(n["tag"], stored["tag"]), "depth": depth_score(n["depth"], stored["depth"])}
        return sum((F.lit(float(weights[k])) * v for k, v in parts.items()), F.lit(0.0))

    return F.transform(nodes, one)


def most_like(dom: Column, stored: Column, weights: Mapping[str, float] | None = None, threshold: float = THRESHOLD, where: Column | None = None) -> Column:
    """The element most like the fingerprint, as a struct (node_id, text, total); null where none scores above the threshold.

    Elements are taken by what they can score at most, and the text and the
    ancestors of those that can't become the best any more are never compared.
    Pages for which `where` isn't true aren't sent, and get null.
    """
    w = WEIGHTS | dict(weights or {})
    whole = sum(w[k] for k in WEIGHTS)

    def likest(page: dict, stored: dict) -> dict | None:
        scores, words, ends, up, tags, classes, ids = (page[k] for k in ("plain", "trimmed", "last_desc", "parent", "tag", "class", "id"))
        wanted, chain = stored["text"], stored["ancestor_path"] or []
        top, place, said = threshold * whole, -1, ""
        for i in sorted(range(len(scores)), key=lambda i: (-scores[i], -i)):
            if scores[i] + w["ancestor"] + w["text"] < top:
                break
            own = " ".join(t for t in words[i : ends[i] + 1] if t)
            most = w["text"] * most_alike(len(own), len(wanted))
            if scores[i] + w["ancestor"] + most < top:
                continue
            above, at = [], up[i]
            while at is not None:
                above.append({"tag": tags[at], "class": classes[at], "id": ids[at]})
                at = up[at]
            total = scores[i] + w["ancestor"] * ancestor_score(above, chain)
            if total + most < top:
                continue
            total += w["text"] * jaro_winkler(own, wanted)
            if total > top or total == top and place >= 0 and i > place:
                top, place, said = total, i, own
        return {"node_id": place, "text": said, "total": top / whole} if place >= 0 else None

    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sent in batches:
            for part in parts(pc.list_value_length(sent.field("plain")), PART_NODES):
                rows = sent[part].to_pylist()
                found = [None if r is None or r["plain"] is None or r["stored"]["text"] is None else likest(r, r["stored"]) for r in rows]
                yield pa.array(found, pa.struct([("node_id", pa.int32()), ("text", pa.string()), ("total", pa.float64())]))

    field = lambda c: F.transform(dom, lambda n: n[c]).alias(c)
    named = lambda c: F.transform(dom, lambda n: _named(n, c)).alias(c)
    sent = F.struct(
        _plain_scores(dom, stored, w).alias("plain"), *map(field, ("trimmed", "last_desc", "parent", "tag")), *map(named, ("class", "id")),
        F.struct(stored["text"].alias("text"), stored["ancestor_path"].alias("ancestor_path")).alias("stored"),
    )
    # one struct, so that what tells whether a page is to be scored is computed once
    needed = stored.isNotNull() if where is None else where & stored.isNotNull()
    return F.arrow_udf(best, _FOUND)(F.when(needed, sent))


def match(dom: Column, selector: str, stored: Column, weights: Mapping[str, float] | None = None, threshold: float = THRESHOLD) -> Column:
    """(node_id, text, similarity_score, healed, error) of a page: the selector's first element, or the one most like its fingerprint."""
    first = F.get(select(dom, selector), F.lit(0))
    like = most_like(dom, stored, weights, threshold, first["node_id"].isNull())

    def told(v: Column) -> Column:
        hit, like = v["first"]["node_id"], v["like"]
        lost = hit.isNull()
        healed = lost & like.isNotNull()
        why = F.when(lost & stored.isNull(), F.lit(f"no fingerprint of {selector!r}")).when(lost & ~healed, F.lit(f"nothing is like what {selector!r} selected"))
        text = F.when(~lost, node_text(dom, v["first"])).otherwise(like["text"])
        return F.struct(F.coalesce(hit, like["node_id"]).alias("node_id"), text.alias("text"), F.when(~lost, 1.0).otherwise(like["total"]).alias("similarity_score"), healed.alias("healed"), why.alias("error"))

    return once(F.struct(first.alias("first"), like.alias("like")), told)


def auto_match(pages: DataFrame, fingerprints: DataFrame, selector: str, weights: Mapping[str, float] | None = None, threshold: float = THRESHOLD, url: str = "url", dom: str = "dom") -> DataFrame:
    """(url, node_id, text, similarity_score, healed, error): one row for each row of the pages.

    Of equal scores the later element wins. Where there is no fingerprint, or
    nothing scores above the threshold, node_id is null and `error` tells why.
    Each page is scored within its own row, so that rows that share a url, or
    have none, are pages of their own.
    """
    rows = attach(pages.select(F.col(url).alias("url"), F.col(dom).alias("dom")), fingerprints, [selector])
    return rows.select("url", match(F.col("dom"), selector, F.col("__stored")[selector], weights, threshold).alias("m")).select("url", "m.*")


def found_fingerprints(rows: DataFrame, found: Mapping[str, str], url: str = "url", dom: str = "dom") -> Column:
    """An array of (selector_used, f, similarity_score) for each selector, whose match is in the column named beside it; f is null where nothing was found."""
    return F.array(*[F.struct(F.lit(s).alias("selector_used"), fingerprint(F.col(dom), F.get(dom, F.col(c)["node_id"])).alias("f"), F.col(c)["similarity_score"].alias("similarity_score")) for s, c in found.items()])


def refresh(pages: DataFrame, matched: DataFrame, selector: str, url: str = "url", dom: str = "dom") -> DataFrame:
    """The fingerprints to store after `auto_match`: of the elements that were found, with their scores."""
    found = matched.where("node_id IS NOT NULL").select(F.col("url").alias("m_url"), "node_id", "similarity_score")
    rows = pages.join(found, F.col(url).eqNullSafe(F.col("m_url"))).select(F.col(url).alias("url"), fingerprint(F.col(dom), F.get(dom, F.col("node_id"))).alias("f"), "similarity_score")
    return rows.select("url", F.lit(selector).alias("selector_used"), "f.*", F.current_timestamp().alias("captured_at"), "similarity_score")


def require(matched: DataFrame) -> DataFrame:
    """As it is, if every page has its element; else MatchError with the first reason."""
    failed = matched.where("error IS NOT NULL").select("url", "error").first()
    if failed is not None:
        raise MatchError(f"{failed['url']}: {failed['error']}")
    return matched
