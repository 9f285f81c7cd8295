"""Product pages written from the relational tables, so that what is read off them can be told from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = """<!DOCTYPE html><html dir="ltr" lang="en"><head><meta charset="utf-8"><title> {name} </title><meta name="Keywords" content="{kind}"><meta property="og:description" content="{brand}"><link href="/s.css" rel="stylesheet"><link href="/i.png" rel="icon"><script src="j/{key}.js">var t = "<p>";</script></head><body><div id="main" class="part size{size}"><h1>{name}</h1><p>Price: <b>{price}</b> net</p><span class="stock">{stock}</span><img src="/img/{key}.png" alt="{name}"><img src="../x.png"><a href="/brand/{brand}">more</a><a href="//cdn.example/{key}">cdn</a><a name="end">end</a><hr><table><tr><th>key</th><th>value</th></tr><tr><td>size</td><td> {size} </td></tr><tbody><tr><td>type</td><td><i>{kind}</i></td></tr></tbody><!-- 1 --></table><table><thead><tr><th>a</th><th>b</th></tr></thead><tr><td>{key}</td></tr><tr></tr></table><form action="/buy" method="POST"><input name="q"><div><select name="n"></select></div><input></form><form><textarea name="note"></textarea></form></div></body></html>"""
_REDESIGNED = """<html><body><div id="shell" class="part"><h2>{name}</h2><p>Only <b>today</b></p><div><em class="cost">{price}</em></div><span class="stock">{stock}</span><hr></div></body></html>"""


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with its {names} replaced."""
    pieces: list[Column] = []
    for k, part in enumerate(template.split("{")):
        name, brace, rest = part.partition("}")
        if k and brace:
            pieces.append(values[name])
            part = rest
        if part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def dollars(amount: str) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.col(amount), 2))


def part_values() -> dict[str, Column]:
    return {
        "key": F.col("p_partkey").cast("string"),
        "name": F.col("p_name"),
        "brand": F.col("p_brand"),
        "kind": F.col("p_type"),
        "size": F.col("p_size").cast("string"),
        "price": dollars("p_retailprice"),
        "stock": F.when(F.col("p_size") > 25, "In Stock").otherwise("Sold Out"),
    }


def _pages(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    url = F.concat(F.lit("http://shop.example/part/"), F.col("p_partkey").cast("string"))
    return spread(part.select("p_partkey", url.alias("url"), filled(template, part_values()).alias("html")))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, _PAGE)


def redesigned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same products under the same URLs, without the elements that selectors knew."""
    return _pages(spark, sf_dir, _REDESIGNED)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the scan gives fewer partitions than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): a page for each region with links to its nations, and for each nation with links to its suppliers and back to its region; one for each supplier with a link to its nation."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    link = lambda kind, key: F.concat(F.lit(f'<li><a href="/{kind}/'), F.col(key).cast("string"), F.lit('">x</a></li>'))
    items = lambda kind, key: F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda k: F.concat(F.lit(f'<li><a href="/{kind}/'), k.cast("string"), F.lit('">x</a></li>'))), "")
    nation, supplier = read("nation"), read("supplier")
    regions = nation.groupBy(F.col("n_regionkey").alias("key")).agg(items("nation", "n_nationkey").alias("body")).select(F.lit("region").alias("kind"), "key", "body")
    sold = supplier.groupBy("s_nationkey").agg(items("supplier", "s_suppkey").alias("body"))
    nations = nation.join(sold, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("key"), F.concat(link("region", "n_regionkey"), F.coalesce("body", F.lit(""))).alias("body"))
    suppliers = supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), link("nation", "s_nationkey").alias("body"))
    pages = regions.unionByName(nations).unionByName(suppliers)
    url = F.concat(F.lit("http://graph.example/"), "kind", F.lit("/"), F.col("key").cast("string"))
    return pages.select(url.alias("url"), F.concat(F.lit("<html><head><title>"), "kind", F.lit("</title></head><body><ul>"), "body", F.lit("</ul></body></html>")).alias("html"))
