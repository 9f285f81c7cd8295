"""Following links over a table of pages, level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.functions.urls import url_join
from domweave.operators.records import Field, extract
from domweave.operators.select import select
from domweave.plans.shared import written
from domweave.sources.pages import with_dom


def page_links(pages: DataFrame, follow: str, kind: str = "css", url: str = "url", dom: str = "dom") -> DataFrame:
    """(src, dst, pos): the resolved href of each element that the selector selects; those that can't be resolved are left out."""
    hrefs = F.transform(select(dom, follow, kind), lambda n: n["attrs"]["href"])
    each = pages.select(F.col(url).alias("src"), F.posexplode(hrefs).alias("pos", "href"))
    return each.select("src", url_join(F.col("src"), F.col("href")).alias("dst"), "pos").where("dst IS NOT NULL")


def reach(seeds: DataFrame, links: DataFrame | None, pages: DataFrame | None = None, follow: str = "", kind: str = "css", depth: int = 3, limit: int | None = None) -> DataFrame:
    """(url, depth, place): what is reached from the seeds' `url` within `depth` steps, each URL once, at its least depth.

    Links are the rows (src, dst, pos) of `links`, or are found on the level's own
    pages by `follow`, so that no page is parsed that isn't reached. Each level
    joins the frontier with the links and anti-joins what was visited; it is
    written to the shared folder. `place` orders a level: the parent's place,
    then the link's. With a limit, levels end once they hold so many URLs
    that have pages, and the first by (depth, place) are returned. URLs are
    compared as strings. Dead links are visited, but are no result where
    `pages` are given.
    """
    first = seeds.select("url").where("url IS NOT NULL").groupBy("url").agg(F.lit(0).alias("depth")).withColumn("place", F.array(F.col("url")))
    frontier = written(first, "level")
    visited, held = [frontier], 0
    known = pages.select("url").distinct() if pages is not None else None

    def results(level: DataFrame) -> DataFrame:
        return level.join(known, "url", "left_semi") if known is not None else level

    for level in range(depth + 1):
        if limit is not None:
            held += results(frontier).limit(limit).count()
            if held >= limit:
                break
        if level == depth or links is None and not follow:
            break
        if links is not None:
            out = links.join(frontier, F.col("src") == F.col("url")).select("dst", "pos", "place")
        else:
            here = pages.select("url", "html").join(frontier.select("url", "place"), "url")
            found = page_links(with_dom(here).drop("html"), follow, kind)
            out = found.join(frontier, F.col("src") == F.col("url")).select("dst", "pos", "place")
        step = F.concat("place", F.array(F.format_string("%012d", F.col("pos").cast("long"))))
        reached = out.select(F.col("dst").alias("url"), step.alias("place")).groupBy("url").agg(F.min("place").alias("place"))
        for old in visited:
            reached = reached.join(old.select("url"), "url", "left_anti")
        frontier = written(reached.select("url", F.lit(level + 1).alias("depth"), "place"), "level")
        if frontier.isEmpty():
            break
        visited.append(frontier)
    total = visited[0]
    for level in visited[1:]:
        total = total.unionByName(level)
    total = results(total)
    return total if limit is None else total.orderBy("depth", "place").limit(limit)


def crawl(pages: DataFrame, seeds: Sequence[str], fields: Sequence[Field] = (), follow: str = "", kind: str = "css", depth: int = 3, limit: int | None = 10, raw: bool = True) -> DataFrame:
    """(url, depth, fields): the records of the pages (url, html) reached from the seeds.

    `raw` leaves out defaults and trimming. The order of discovery is that of
    (depth, place); of rows that share a url one is taken.
    """
    spark = pages.sparkSession
    start = spark.createDataFrame([(s,) for s in seeds], "url string")
    found = reach(start, None, pages, follow, kind, depth, limit)
    here = pages.select("url", "html").join(found, "url").dropDuplicates(["url"])
    records = extract(with_dom(here).drop("html"), fields, raw=raw)
    return records.orderBy("depth", "place").drop("place")
