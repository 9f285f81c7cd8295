"""Registered queries of the extraction engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domweave.functions import similarity as sim
from domweave.functions import values
from domweave.functions.urls import url_join
from domweave.operators import change, crawl, derive, heal, records
from domweave.operators.records import Constraint, Field, Rule
from domweave.operators.select import select, select_ids
from domweave.plans.shared import shared_folder, written
from domweave.plans.shop import dollars, link_pages, part_pages, redesigned_pages, spread
from domweave.sources import pages as P
from domweave.sources import sinks
from domweave.streaming.watch import watch_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return P.with_dom(spread(_read(spark, sf_dir, "pages").select("page_id", *columns, "html"))).drop("html")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_dom(part_pages(spark, sf_dir)).drop("html")


def _size(nodes: Column) -> Column:
    return F.size(nodes).cast("bigint")


# raw pages

@registered("SELECT page_id, url, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, "url").select("page_id", "url", derive.title(F.col("dom")).alias("title"))


@registered("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset FROM pages""")
def page_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom = F.col("dom")
    return _pages(spark, sf_dir).select("page_id", derive.attribute(select(dom, "html"), "lang").alias("lang"), derive.attribute(select(dom, "//meta", "xpath"), "charset").alias("charset"))


@registered("""
WITH h AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
e AS (SELECT page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM h)
SELECT page_id, pos, regexp_extract(url, '^(https?://[^/]*)', 1) || replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%27', ''''), '%21', '!') AS link FROM e""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, "url").select("page_id", derive.links(F.col("dom"), F.col("url")).alias("links"))
    return pages.select("page_id", F.posexplode("links").alias("pos", "link")).withColumn("pos", F.col("pos").cast("bigint"))


@registered("""
WITH n AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages),
t AS (SELECT page_id, regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1) AS ts FROM n)
SELECT page_id, len(ts)::BIGINT AS n_links, array_to_string(list_filter(list_transform(ts, lambda x: trim(x)), lambda x: x <> ''), ' ') AS nav_text FROM t""")
def css_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom, hit = F.col("dom"), select("dom", "nav li a")
    return _pages(spark, sf_dir).select("page_id", _size(hit).alias("n_links"), derive.joined_text(dom, hit).alias("nav_text"))


_CSS = {
    "n_class": ("div.ad", "<div class=\"ad\"[ >]"),
    "n_any": ("[href]", " href=\""),
    "n_equal": ("meta[charset='utf-8']", "<meta charset=\"utf-8\""),
    "n_word": ("div[class~=ad]", "<div class=\"ad\""),
    "n_hyphen": ("html[lang|=de]", "<html lang=\"de[\"-]"),
    "n_prefix": ("a[href^='/t']", "<a href=\"/t"),
    "n_suffix": ("a[href$=',']", "<a href=\"[^\"]*,\""),
    "n_part": ("a[href*='e']", "<a href=\"[^\"]*e[^\"]*\""),
    "n_two": ("article h1", "<h1[ >]"),
}


@registered("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{p}'))::BIGINT AS {n}" for n, (_, p) in _CSS.items()) + ", 0::BIGINT AS n_child FROM pages")
def css_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [_size(select("dom", s)).alias(n) for n, (s, _) in _CSS.items()]
    return _pages(spark, sf_dir).select("page_id", *counts, _size(select("dom", "nav > ul")).alias("n_child"))


_XPATH = {
    "n_any": ("//a", "<a[ >]"),
    "n_class": ("//div[@class='ad']", "<div class=\"ad\""),
    "n_path": ("/html/body/article/h1", "<h1[ >]"),
    "n_star": ("//nav/*", "<ul[ >]|<li[ >]|<a href"),
    "n_equal": ("//html[@lang='fr']", "<html lang=\"fr\""),
    "n_ignored": ("//html[@lang]", "<html[ >]"),
}


@registered("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{p}'))::BIGINT AS {n}" for n, (_, p) in _XPATH.items()) + " FROM pages")
def xpath_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", *[_size(select("dom", s, "xpath")).alias(n) for n, (s, _) in _XPATH.items()])


@registered("""
WITH t AS (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages)
SELECT tag, count(*) AS n FROM t GROUP BY tag""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nodes(_pages(spark, sf_dir)).groupBy("tag").agg(F.count("*").alias("n"))


@registered("""
WITH t AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c, list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS g FROM pages)
SELECT page_id, round(CASE WHEN len(c) + len(g) = 0 THEN 1.0 ELSE len(list_intersect(c, g)) / len(list_distinct(list_concat(c, g))) END, 6) AS score FROM t""")
def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom = F.col("dom")
    classes = F.array_distinct(F.filter(derive.attributes(dom, "class"), lambda c: c.isNotNull()))
    return _pages(spark, sf_dir).select("page_id", F.round(sim.jaccard(classes, F.array_distinct(F.transform(dom, lambda n: n["tag"]))), 6).alias("score"))


@registered("""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages)
SELECT page_id, host, (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) / 2.0::DOUBLE AS start_s FROM h""")
def polite_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"))
    return P.polite_schedule(pages, 2.0, "host", "page_id")


@registered("""
SELECT c_custkey, 'id=' || c_custkey || '; Path=/' AS header, c_custkey::VARCHAR AS id, c_name AS name,
  CASE WHEN c_nationkey > 12 THEN 'latin-1' ELSE 'utf-8' END AS charset FROM customer""")
def response_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    first = F.concat(F.lit("id="), F.col("c_custkey").cast("string"), F.lit("; Path=/"))
    c = c.select("c_custkey", first.alias("header"), F.array(F.lit("id=old"), first, F.concat(F.lit(" name = "), "c_name", F.lit(";")), F.lit("junk")).alias("cookies"), F.when(F.col("c_nationkey") > 12, "text/html; charset= latin-1 ").otherwise("text/html").alias("type"))
    found = P.cookie_map("cookies")
    return c.select("c_custkey", "header", found["id"].alias("id"), found["name"].alias("name"), P.charset("type").alias("charset"))


# product pages

@registered("""
SELECT p_partkey, p_name AS name, '$' || format('{:,.2f}', p_retailprice) AS price,
  CASE WHEN p_size > 25 THEN 'IN STOCK' ELSE 'SOLD OUT' END AS stock, 'none' AS missing, '' AS nothing FROM part""")
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [Field("name", "h1"), Field("price", "//p/b", "xpath"), Field("stock", "span.stock", transform=F.upper), Field("missing", "h5.x", default="none"), Field("nothing", "#none")]
    return records.extract(_parts(spark, sf_dir), fields).drop("url")


@registered("""
SELECT p_partkey, printf('%.2f', p_retailprice) AS price, 'http://shop.example/brand/' || p_brand AS brand_url, p_size::VARCHAR AS size,
  'http://shop.example/part/more' AS joined, '2024-03-05' AS day FROM part""")
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        Rule("price", "b", type="price"), Rule("brand_url", "a[href^='/brand']", type="attribute", attribute="href"), Rule("size", "size", "after_text"),
        Rule("joined", "a[href^='/brand']", type="url"), Rule("day", "#none", type="date", default="2024-03-05"),
    ]
    out = records.apply_rules(_parts(spark, sf_dir), rules)
    return out.select("p_partkey", "price", F.concat(F.lit("http://shop.example"), "brand_url").alias("brand_url"), F.trim("size").alias("size"), "joined", "day")


@registered("""
SELECT p_partkey, unnest([0, 1, 2, 3, 4])::BIGINT AS position, unnest(['size', p_size::VARCHAR, 'type', p_type, p_partkey::VARCHAR]) AS cell,
  unnest([p_name, '', '', '', '']) AS name FROM part""")
def record_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.extract_lists(_parts(spark, sf_dir), [Field("cell", "td"), Field("name", "h1")])
    return out.select("p_partkey", F.col("position").cast("bigint").alias("position"), "cell", "name")


@registered("""SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice) AS price_mark, 'In Stock' AS one, p_size::VARCHAR AS after, p_name AS before, 1::BIGINT AS n_regex, 0::BIGINT AS n_script
  FROM part WHERE p_size > 25
UNION ALL SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice), '', p_size::VARCHAR, p_name, 1, 0 FROM part WHERE p_size <= 25""")
def regex_and_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom = F.col("dom")
    text = lambda s, k: derive.combined_text(dom, select(dom, s, k))
    return _parts(spark, sf_dir).select(
        "p_partkey", text(r"^\$[\d,]+\.\d\d$", "regex").alias("price_mark"), text("In Stock", "text").alias("one"), text("size", "after_text").alias("after"),
        derive.joined_text(dom, select(dom, "Price:", "before_text")).alias("before"), _size(select(dom, r"\bnet\b", "regex")).alias("n_regex"), _size(select(dom, "var t", "text")).alias("n_script"),
    )


@registered("""
SELECT p_partkey, p_name || chr(10) || '# ' || p_name || chr(10) || chr(10) || chr(10) || 'Price:  net' || chr(10) || '$' || format('{:,.2f}', p_retailprice)
  || CASE WHEN p_size > 25 THEN 'In Stock' ELSE 'Sold Out' END || '![' || p_name || '](/img/' || p_partkey || '.png)![](../x.png)[more](/brand/' || p_brand || ')[cdn](//cdn.example/' || p_partkey || ')end'
  || chr(10) || '---' || chr(10) || 'keyvaluesize' || p_size || 'type' || p_type || 'ab' || p_partkey AS markdown FROM part""")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", derive.markdown(F.col("dom")).alias("markdown"))


@registered("""
SELECT p_partkey, p_name || ' ' || p_name || ' Price:  net $' || format('{:,.2f}', p_retailprice) || ' ' || CASE WHEN p_size > 25 THEN 'In Stock' ELSE 'Sold Out' END
  || ' more cdn end key value size ' || p_size || ' type ' || p_type || ' a b ' || p_partkey AS text FROM part""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", derive.page_text(F.col("dom")).alias("text"))


@registered("""
SELECT p_partkey, 0::BIGINT AS n, ['key', 'value'] AS headers, [['size', p_size::VARCHAR], ['type', p_type]] AS rows FROM part
UNION ALL SELECT p_partkey, 1, ['a b'], [[p_partkey::VARCHAR]] FROM part""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _parts(spark, sf_dir).select("p_partkey", F.posexplode(derive.tables(F.col("dom"))).alias("n", "t"))
    return found.select("p_partkey", F.col("n").cast("bigint").alias("n"), "t.headers", "t.rows")


@registered("""
SELECT p_partkey, '/buy' AS action, 'POST' AS method, ['q', 'n'] AS inputs FROM part
UNION ALL SELECT p_partkey, NULL, 'get', ['note'] FROM part""")
def page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", F.explode(derive.forms(F.col("dom"))).alias("f")).select("p_partkey", "f.*")


@registered("SELECT p_partkey, p_name AS title, p_type AS keywords, p_brand AS og_description, p_brand AS description, 'utf-8' AS charset, 5::BIGINT AS n FROM part")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    found = _parts(spark, sf_dir).select("p_partkey", derive.metadata(F.col("dom")).alias("m"))
    return found.select("p_partkey", *[m[k].alias(k) for k in ("title", "keywords", "og_description", "description", "charset")], _size(F.map_keys(m)).alias("n"))


@registered("""
SELECT p_partkey, 'http://shop.example/img/' || p_partkey || '.png' AS src, p_name AS alt FROM part
UNION ALL SELECT p_partkey, 'http://shop.example/x.png', NULL FROM part""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _parts(spark, sf_dir).select("p_partkey", derive.images(F.col("dom"), F.col("url")).alias("images"))
    return found.select("p_partkey", F.explode("images").alias("i")).select("p_partkey", "i.*")


@registered("""
SELECT p_partkey, ['http://shop.example/brand/' || p_brand, 'http://cdn.example/' || p_partkey] AS links,
  ['http://shop.example/part/j/' || p_partkey || '.js'] AS scripts, ['http://shop.example/s.css'] AS styles FROM part""")
def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom, url = F.col("dom"), F.col("url")
    return _parts(spark, sf_dir).select("p_partkey", derive.links(dom, url).alias("links"), derive.scripts(dom, url).alias("scripts"), derive.styles(dom, url).alias("styles"))


@registered("""
SELECT p_partkey, 'div' AS parent_tag, 'p' AS next_tag, NULL::VARCHAR AS prev_tag, 12::BIGINT AS n_siblings, 13::BIGINT AS n_children, ['more', 'cdn', 'end'] AS link_texts, 'end' AS last_link, 3::BIGINT AS depth FROM part""")
def node_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom = F.col("dom")
    h1, links = F.get(select(dom, "h1"), F.lit(0)), select(dom, "a")
    parts = _parts(spark, sf_dir).select("p_partkey", "dom", h1.alias("h1"), links.alias("links"))
    n, up = F.col("h1"), F.get(dom, F.col("h1.parent"))
    following, before = F.get(dom, P.next_sibling(dom, n)), F.get(dom, n["prev"])
    texts = derive.texts(dom, F.col("links"))
    return parts.select(
        "p_partkey", up["tag"].alias("parent_tag"), following["tag"].alias("next_tag"), before["tag"].alias("prev_tag"), _size(P.siblings(dom, n)).alias("n_siblings"),
        _size(P.children(dom, up)).alias("n_children"), texts.alias("link_texts"), F.element_at(texts, -1).alias("last_link"), n["depth"].cast("bigint").alias("depth"),
    )


# values

@registered("""
SELECT o_orderkey, printf('%.2f', o_totalprice) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day_words, strftime(o_orderdate, '%Y-%m-%d') AS day_first,
  strftime(o_orderdate, '%Y-%m-%d') AS day_slash, o_orderpriority AS day_none FROM orders""")
def normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda f: values.date(F.date_format("o_orderdate", f))
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", values.price(F.concat(F.lit(" EUR "), dollars("o_totalprice"))).alias("price"), day("MMMM d, yyyy").alias("day_words"), day("d MMMM yyyy").alias("day_first"), day("MM/dd/yyyy").alias("day_slash"),
        values.date(F.concat(F.lit("\t"), "o_orderpriority", F.lit(" \n"))).alias("day_none"),
    )


_CUSTOMER = [Constraint("name", required=True), Constraint("nation", "integer"), Constraint("balance", "float"), Constraint("rich", "boolean"), Constraint("segment", "integer")]


@registered("""
SELECT c_custkey, c_name AS name, c_nationkey::VARCHAR AS nation, printf('%.2f', c_acctbal) AS balance, CASE WHEN c_acctbal > 5000 THEN 'true' ELSE 'false' END AS rich,
  CASE WHEN c_nationkey > 20 THEN 'Field ''segment'': value ''' || c_mktsegment || ''' is not a valid integer' END AS error FROM customer""")
def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit(" "), "c_name").alias("name"), F.concat(F.lit("no "), F.col("c_nationkey").cast("string")).alias("nation"), dollars("c_acctbal").alias("balance"),
        F.when(F.col("c_acctbal") > 5000, "Yes").otherwise("0").alias("rich"), F.when(F.col("c_nationkey") > 20, F.col("c_mktsegment")).otherwise("").alias("segment"),
    )
    return records.validate(c, _CUSTOMER, keep=["c_custkey"]).drop("segment")


@registered("SELECT s_suppkey, 'Required field ''phone'' is missing or empty' AS error FROM supplier")
def schema_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").withColumn("phone", F.lit(" \t"))
    return records.good_and_rejects(records.validate(s, [Constraint("s_name"), Constraint("phone", required=True)], keep=["s_suppkey"]))[1].select("s_suppkey", "error")


@registered("""SELECT p_partkey, 'https://e.com/a/b/' || p_partkey AS plain, 'https://e.com/' || p_partkey AS root, 'https://e.com/a/b/c?x=1#' || p_partkey AS fragment, 'https://e.com/a/' || p_partkey AS up, 'http://h.org/' AS other FROM part""")
def url_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    at = lambda *parts: url_join(F.lit("https://E.com:443/a/b/c?x=1#f"), F.concat(*parts))
    return _read(spark, sf_dir, "part").select("p_partkey", at(key).alias("plain"), at(F.lit("/./"), key).alias("root"), at(F.lit("#"), key).alias("fragment"), at(F.lit("../"), key).alias("up"), at(F.lit(" HTTP://H.org:80")).alias("other"))


@registered("""
SELECT p_partkey, round(jaro_winkler_similarity(p_name, lower(p_type) || ' ring'), 6) AS text_score, CASE WHEN lower(p_type) = p_brand THEN 1.0 ELSE 0.0 END AS tag,
  round(1.0 / (1 + abs(p_size - 10)), 6) AS depth FROM part""")
def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sim.text_similarity(F.col("p_name"), F.concat(F.lower("p_type"), F.lit(" ring")))
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(text, 6).alias("text_score"), sim.tag_score(F.col("p_type"), F.col("p_brand")).alias("tag"), F.round(sim.depth_score(F.col("p_size"), F.lit(10)), 6).alias("depth"))


# healing

@registered("""
WITH r AS (SELECT user_id::VARCHAR AS url, event_type AS selector_used, event_id AS hash, value AS text, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT url, selector_used, hash, text FROM r WHERE k = 1""")
def fingerprint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("selector_used"), F.col("event_id").alias("hash"), F.col("value").alias("text"), F.col("ts").alias("captured_at"))
    return heal.latest(e).drop("captured_at")


@registered("SELECT p_partkey, 'b' AS tag, '$' || format('{:,.2f}', p_retailprice) AS text, '<b>' AS html_snippet, 4::BIGINT AS depth, 0::BIGINT AS sibling_index, 'p' AS parent_tag, '' AS parent_class, ['p', 'div', 'body', 'html'] AS path FROM part")
def fingerprint_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = heal.capture(_parts(spark, sf_dir), ["p b"])
    key = F.substring_index("url", "/", -1).cast("bigint").alias("p_partkey")
    path = F.transform("ancestor_path", lambda a: a["tag"])
    return f.select(key, "tag", "text", "html_snippet", F.col("depth").cast("bigint").alias("depth"), F.col("sibling_index").cast("bigint").alias("sibling_index"), "parent_tag", "parent_class", path.alias("path"))


@registered("""
SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice) AS text, 0.753333::DOUBLE AS score, true AS healed FROM part""")
def auto_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price after a redesign, found in the element around it: text 1, class 1, ancestors (0.4 + 1 + 1) / 4, attributes 1, tag 0, depth 0.5, so (2 + 1.5 + 0.9 + 1 + 0.25) / 7.5."""
    stored = written(heal.capture(_parts(spark, sf_dir), ["p b"]), "fingerprints")
    # fingerprints are met before the pages are parsed
    pages = P.with_dom(heal.attach(redesigned_pages(spark, sf_dir), stored.withColumn("selector_used", F.lit("span.price")), ["span.price"])).drop("html")
    m = pages.select("url", heal.match(F.col("dom"), "span.price", F.col("__stored")["span.price"]).alias("m"))
    return m.select(F.substring_index("url", "/", -1).cast("bigint").alias("p_partkey"), "m.text", F.round("m.similarity_score", 6).alias("score"), "m.healed")


@registered("""
WITH v AS (SELECT p_partkey, p_partkey % 4 AS kind, '$' || format('{:,.2f}', p_retailprice) AS old FROM part),
t AS (SELECT *, CASE WHEN p_partkey % 8 >= 4 THEN old || ' now' ELSE old END AS new FROM v),
s AS (SELECT *, jaro_winkler_similarity(new, old) AS alike FROM t)
SELECT p_partkey, CASE kind WHEN 3 THEN NULL ELSE new END AS text,
  round(CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN (2 * alike + 1.5 * 3.7 / 4 + 1 + 0.5) / 7.5 WHEN 2 THEN (2 * alike + 1.5 + 1.5 * 3.7 / 5 + 1 + 0.25) / 7.5 END, 6) AS score,
  kind IN (1, 2) AS healed, CASE kind WHEN 3 THEN 'nothing is like what ''b.price'' selected' END AS error FROM s""")
def auto_match_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four kinds after a redesign: as they were, of another class, of another tag and depth, and without the element; half of them with another text."""
    part = spread(_read(spark, sf_dir, "part"))
    page = lambda inner, price: F.concat(F.lit('<html><body><div id="main" class="part"><p class="c">'), F.lit(inner[0]), price, F.lit(inner[1]), F.lit("</p></div></body></html>"))
    key, price = F.col("p_partkey"), dollars("p_retailprice")
    url, now = F.concat(F.lit("http://shop.example/part/"), key.cast("string")), F.when(key % 8 >= 4, F.concat(price, F.lit(" now"))).otherwise(price)
    kept = ('<b class="price">', "</b>")
    after = F.when(key % 4 == 0, page(kept, now)).when(key % 4 == 1, page(('<b class="cost">', "</b>"), now)).when(key % 4 == 2, page(('<i><em class="price">', "</em></i>"), now)).otherwise(F.lit("<html><u>x</u></html>"))
    stored = heal.capture(P.with_dom(part.select(url.alias("url"), page(kept, price).alias("html"))), ["b.price"])
    # fingerprints are met before the pages are parsed
    pages = P.with_dom(heal.attach(part.select("p_partkey", url.alias("url"), after.alias("html")), stored, ["b.price"])).drop("html")
    m = pages.select("p_partkey", heal.match(F.col("dom"), "b.price", F.col("__stored")["b.price"]).alias("m"))
    return m.select("p_partkey", "m.text", F.round("m.similarity_score", 6).alias("score"), "m.healed", "m.error")


@registered("""
SELECT 'http://shop.example/part/' || p_partkey AS url, 'b' AS tag, '$' || format('{:,.2f}', p_retailprice) AS text, CASE WHEN p_size > 25 THEN 0.75 ELSE 1.0 END::DOUBLE AS score
FROM part WHERE p_partkey NOT IN (1, 2)""")
def fingerprint_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two puts, of which the second has some of the keys, and two deletions."""
    import uuid

    store = heal.FingerprintStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    found = written(heal.capture(_parts(spark, sf_dir), ["p b"]), "fingerprints")  # or each put would parse the pages
    store.put(found)
    later = F.expr("captured_at + INTERVAL 1 MINUTE")
    store.put(found.join(_parts(spark, sf_dir).where("p_size > 25").select("url"), "url", "left_semi").select(*found.columns).withColumn("captured_at", later).withColumn("similarity_score", F.lit(0.75)))
    for key in (1, 2):
        store.delete(f"http://shop.example/part/{key}", "p b", later=True)
    return store.scan().select("url", "tag", "text", F.col("similarity_score").alias("score"))


# sinks and streams

@registered("""
WITH t AS (SELECT p_partkey::VARCHAR AS key, p_name AS name, '$' || format('{:,.2f}', p_retailprice) AS price FROM part)
SELECT f AS format, key, name, price FROM t, (SELECT unnest(['csv', 'json', 'parquet']) AS f)""")
def sink_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records written in each format and read back."""
    import uuid

    made = written(records.extract(_parts(spark, sf_dir), [Field("name", "h1"), Field("price", "p b")]).select(F.col("p_partkey").cast("string").alias("key"), "name", "price"), "records")
    out = []
    for form in sinks.FORMATS:
        path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
        sinks.write(made, path, form)
        back = spark.read.option("header", True).schema(made.schema).format(form).load(path)
        out.append(back.select(F.lit(form).alias("format"), "key", "name", "price"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@registered("""
WITH t AS (SELECT page_id, url, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<a[ >]')) AS n FROM pages)
SELECT 'good' AS side, page_id, title, NULL AS error FROM t WHERE n % 2 = 0
UNION ALL SELECT 'reject', page_id, title, 'Required field ''even'' is missing or empty' FROM t WHERE n % 2 = 1""")
def stream_good_and_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a stream, their records validated, and the good ones and the rejects each in a folder."""
    import uuid

    from domweave.streaming.watch import page_stream

    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    pages = page_stream(spark, f"{sf_dir}/pages.parquet*").select("page_id", "url", "html")
    rows = P.with_dom(pages).select("page_id", derive.title(F.col("dom")).alias("title"), F.when(F.size(select_ids("dom", "a")) % 2 == 0, "yes").otherwise("").alias("even"))
    checked = records.validate(rows, [Constraint("title"), Constraint("even", required=True)], keep=["page_id"])
    sinks.stream_split(checked, f"{at}/good", f"{at}/reject", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    good, bad = (spark.read.schema(checked.schema).parquet(f"{at}/{side}").select(F.lit(side).alias("side"), "page_id", "title", "error") for side in ("good", "reject"))
    return good.unionByName(bad)


@registered("""
SELECT p_partkey, p_partkey::VARCHAR AS d, '3' AS doubled, 0::BIGINT AS below_path, 0::BIGINT AS below_g, 'b' || p_size AS text, 1::BIGINT AS stray FROM part""")
def element_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes are void, of attributes of one name the last holds, foreign elements that close themselves are leaves, and stray end tags do nothing."""
    key = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<svg></u><path d="'), key, F.lit('"><g a="1" A="2" a="3"/><b>b'), F.col("p_size").cast("string"), F.lit("</b></svg></b><hr>"))
    pages = P.with_dom(spread(_read(spark, sf_dir, "part")).select("p_partkey", html.alias("html")))
    below = lambda s: F.size(P.children(F.col("dom"), F.get(select("dom", s), F.lit(0)))).cast("bigint")
    attribute = lambda s, n: derive.attribute(select("dom", s), n)
    return pages.select("p_partkey", attribute("path", "d").alias("d"), attribute("g", "a").alias("doubled"), below("path").alias("below_path"), below("g").alias("below_g"), derive.joined_text(F.col("dom"), select("dom", "svg b")).alias("text"), _size(select_ids("dom", "hr")).alias("stray"))


@registered("""
SELECT 'http://shop.example/part/' || p_partkey AS url, upper(p_name) AS name, 'PRICE: ' || '$' || format('{:,.2f}', p_retailprice) AS price, p_size > 25 AS many FROM part""")
def hooked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session whose hooks mark prices before parsing and put what is extracted in capitals."""
    from domweave.api import Session, upper

    marked = lambda html: F.replace(html, F.lit("<b>$"), F.lit("<b>price: $"))
    session = Session(spark, part_pages(spark, sf_dir), before_parse=(marked,), after_extract=(upper,))
    out = session.dataset().field("name", "h1").field("price", "p b").field("stock", ".stock").build()
    return out.select("url", "name", "price", (F.col("stock") == "IN STOCK").alias("many"))


@registered("""
SELECT p_partkey, regexp_replace('$' || format('{:,.2f}', p_retailprice), '[^0-9.]', '', 'g') || '.5' AS strict, regexp_replace('$' || format('{:,.2f}', p_retailprice), '[^0-9]', '', 'g') || '.5' AS lenient, '' AS emptied, 'none' AS missing FROM part""")
def record_rules_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in both ways: a price with two points keeps both or the last, and what is empty after cleaning stays empty or takes the default."""
    html = F.concat(F.lit("<b>"), dollars("p_retailprice"), F.lit(".5</b><i>soon</i>"))
    pages = P.with_dom(spread(_read(spark, sf_dir, "part")).select("p_partkey", F.lit("http://shop.example/").alias("url"), html.alias("html"))).drop("html")
    rules = [Rule("strict", "b", type="price"), Rule("emptied", "i", type="price", default="0"), Rule("missing", "u", default="none")]
    both = records.apply_rules(pages, rules, strict=True)
    lenient = records.apply_rules(pages, [Rule("lenient", "b", type="price")]).select("p_partkey", "lenient")
    return both.join(lenient, "p_partkey").select("p_partkey", "strict", "lenient", "emptied", "missing")


# change

_CHANGES = """
WITH a AS (SELECT o_custkey, max(o_totalprice)::DECIMAL(18,2)::VARCHAR AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey, max(o_totalprice)::DECIMAL(18,2)::VARCHAR AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS o, b.v AS n FROM a FULL JOIN b USING (o_custkey) WHERE a.v IS DISTINCT FROM b.v)
SELECT o_custkey, coalesce(o, '') AS old_value, coalesce(n, '') AS new_value, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'price' END AS change_type,
  round(CASE WHEN o IS NOT NULL AND n IS NOT NULL THEN (n::DOUBLE - o::DOUBLE) / o::DOUBLE * 100 END, 4) AS diff_pct,
  CASE WHEN o IS NULL THEN '+ ' || n WHEN n IS NULL THEN '- ' || o ELSE '- ' || o || chr(10) || '+ ' || n END AS diff FROM j"""


@registered(_CHANGES)
def change_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    side = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.max("o_totalprice").cast("decimal(18,2)").cast("string").alias("value"))
    return change.detect(side("F"), side("O"), ["o_custkey"]).select("o_custkey", "old_value", "new_value", "change_type", F.round("diff_pct", 4).alias("diff_pct"), "diff")


@registered("""
WITH s AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'In stock' WHEN p_size > 25 THEN 'unavailable' WHEN p_size > 10 THEN 'sold out' ELSE p_name END AS o,
  CASE WHEN p_retailprice > 950 THEN 'In stock' ELSE 'Sold Out' END AS n FROM part)
SELECT p_partkey, o AS old_value, n AS new_value, 'StockChange' AS label, n = 'In stock' AS in_stock FROM s WHERE o <> n""")
def change_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, size = _read(spark, sf_dir, "part"), F.col("p_size")
    old = part.select("p_partkey", F.when(size > 40, "In stock").when(size > 25, "unavailable").when(size > 10, "sold out").otherwise(F.col("p_name")).alias("value"))
    new = part.select("p_partkey", F.when(F.col("p_retailprice") > 950, "In stock").otherwise("Sold Out").alias("value"))
    return change.detect(old, new, ["p_partkey"]).select("p_partkey", "old_value", "new_value", change.camel_label(F.col("change_type")).alias("label"), "in_stock")


_WATCH = """
WITH s AS (SELECT user_id, event_type, event_id, value::DECIMAL(18,2)::VARCHAR AS n, lag(value::DECIMAL(18,2)::VARCHAR) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS o FROM events)
SELECT user_id, event_type, event_id, o AS old_value, n AS new_value, 'price' AS change_type, round(CASE WHEN o::DOUBLE <> 0 THEN (n::DOUBLE - o::DOUBLE) / o::DOUBLE * 100 ELSE 0 END, 4) AS diff_pct FROM s WHERE o <> n"""


def _watched(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_type", "event_id", "old_value", "new_value", "change_type", F.round("diff_pct", 4).alias("diff_pct"))


@registered(_WATCH)
def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return _watched(change.watch(e, ["user_id", "event_type"], ["ts", "event_id"]))


@registered(_WATCH)
def watch_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream with keyed state, run until its source is read."""
    import uuid

    source = _read(spark, sf_dir, "events")
    e = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("value", F.col("value").cast("decimal(18,2)"))
    at = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    found = watch_stream(e, ["user_id", "event_type"], ["ts", "event_id"])
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return _watched(spark.read.schema(found.schema).parquet(f"{at}/out"))


# crawling

@registered("""
SELECT DISTINCT 'http://graph.example/region/' || n_regionkey AS url, 0 AS depth, 'region' AS title FROM nation
UNION ALL SELECT 'http://graph.example/nation/' || n_nationkey, 1, 'nation' FROM nation
UNION ALL SELECT 'http://graph.example/supplier/' || s_suppkey, 2, 'supplier' FROM supplier""")
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = [f"http://graph.example/region/{r[0]}" for r in _read(spark, sf_dir, "region").select("r_regionkey").collect()]
    return crawl.crawl(written(link_pages(spark, sf_dir), "pages"), seeds, [Field("title", "title")], follow="li a", depth=3, limit=None)


# a link leads from a supplier to a part or back, so that each level is of the other kind than the one before
@registered("""
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
p1 AS (SELECT DISTINCT p FROM e WHERE s = 0),
s2 AS (SELECT DISTINCT s FROM e SEMI JOIN p1 USING (p)),
p3 AS (SELECT DISTINCT p FROM e SEMI JOIN s2 USING (s))
SELECT 's0' AS url, 0 AS depth
UNION ALL SELECT 'p' || p, 1 FROM p1
UNION ALL SELECT 's' || s, 2 FROM s2 WHERE s <> 0
UNION ALL SELECT 'p' || p, 3 FROM p3 ANTI JOIN p1 USING (p)""")
def crawl_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What s0 reaches in three steps over the links of all rows."""
    li = _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p")).distinct()
    links = li.select(F.col("s").alias("src"), F.col("p").alias("dst")).unionByName(li.select(F.col("p").alias("src"), F.col("s").alias("dst"))).withColumn("pos", F.lit(0))
    return crawl.reach(spark.createDataFrame([("s0",)], "url string"), links, depth=3).select("url", "depth")


# the table of elements

@registered("SELECT p_partkey, 48::BIGINT AS n_nodes, 7::BIGINT AS max_depth, 47::BIGINT AS last_of_root, 2::BIGINT AS n_h1, 'div' AS tag_of_main FROM part")
def dom_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom = F.col("dom")
    depth = F.array_max(F.transform(dom, lambda n: n["depth"]))
    return _parts(spark, sf_dir).select("p_partkey", _size(dom).alias("n_nodes"), depth.cast("bigint").alias("max_depth"), F.get(dom, F.lit(0))["last_desc"].cast("bigint").alias("last_of_root"), (F.size(select_ids(dom, "h1")) + F.size(select_ids(dom, "title"))).cast("bigint").alias("n_h1"), F.get(select(dom, "#main"), F.lit(0))["tag"].alias("tag_of_main"))
