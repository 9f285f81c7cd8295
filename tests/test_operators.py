"""Views, records, values, healing, change detection and crawling on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from domweave.errors import ExportError, MatchError, SchemaError
from domweave.functions import similarity as sim
from domweave.functions import values
from domweave.functions.urls import resolve
from domweave.operators import change, crawl, derive, heal, records
from domweave.operators.records import Constraint, Field, Rule
from domweave.sources import sinks
from domweave.sources.pages import with_dom

URL = "https://example.com/edge-cases"


@pytest.fixture(scope="module")
def page(spark):
    return lambda html, url=URL: with_dom(spark.createDataFrame([(url, html)], "url string, html string"))


def test_markdown(page):
    html = '<html><body><h1>T</h1><p>a <b>x</b> c</p><hr><a href="/u">l</a><img src="i.png" alt="q"></body></html><div>other root</div>'
    assert page(html).select(derive.markdown(F.col("dom"))).first()[0] == "\n# T\n\n\na  c\nx\n---\n[l](/u)![q](i.png)"
    assert page("<a href=u></a>").select(derive.markdown(F.col("dom"))).first()[0] == "<u>"
    assert page("").select(derive.markdown(F.col("dom")), derive.title(F.col("dom")), derive.page_text(F.col("dom"))).first()[:] == ("", "", "")


@pytest.mark.parametrize(
    "reference, expected",
    [
        ("/relative-path", "https://example.com/relative-path"), ("//Example.com/p", "https://example.com/p"), ("#s", URL + "#s"), ("mailto:a@b.c", "mailto:a@b.c"), ("javascript:void(0)", "javascript:void(0)"),
        ("/für", "https://example.com/f%C3%BCr"), ("../a/./b/..", "https://example.com/a/"), ("?q=ü", URL + "?q=%C3%BC"), ("", URL), ("HTTPS://münchen.de:443", "https://xn--mnchen-3ya.de/"), ("http://", None), ("a b\\c", "https://example.com/a%20b/c"),
    ],
)
def test_resolve(reference, expected):
    assert resolve(URL, reference) == expected


def test_bases():
    assert resolve("not a url", "/x") is None and resolve(None, "x") is None and resolve("mailto:a", "x") is None


def test_tables(page):
    html = """<table><thead><tr id=h><th>Merged<th>Header</th></th></tr></thead>
<tbody id=b><tr><td>a <b>b</b></td><td></td></tr><tr></tr></tbody></table>
    <table><tr><th>Who</th>
<th>Years</th></tr><tr id=r><td>Alice<table><tr><td>in</td></tr></table></td><td>30</td><!-- r --></tr></table><table></table>"""
    found = page(html).select(derive.tables(F.col("dom"))).first()[0]
    assert [(t.headers, t.rows) for t in found] == [(["Merged Header"], [["a b", ""]]), (["Who", "Years"], [["Alice in", "30"]]), (["in"], []), ([], [])]


def test_forms_and_metadata(page):
    row = page("<head><meta property='og:description' content='d'><meta charset=UTF-8><meta name=A content=1><meta name=a content=2></head><form action='/s'><p><input name=q><input></p></form>")
    row = row.select(derive.forms(F.col("dom")).alias("f"), derive.metadata(F.col("dom")).alias("m")).first()
    assert [tuple(f) for f in row.f] == [("/s", "get", ["q"])]
    assert row.m == {"og_description": "d", "charset": "UTF-8", "a": "2", "description": "d"}


def test_links_keep_what_cant_be_resolved(page):
    html = "<a href='/x'>1</a><a>2</a><a href='http://'>3</a>"
    assert page(html).select(derive.links(F.col("dom"), F.col("url"))).first()[0] == ["https://example.com/x", "http://"]
    assert page(html, "nothing").select(derive.links(F.col("dom"), F.col("url"))).first()[0] == ["/x", "http://"]


def test_links_are_resolved_in_small_parts():
    import pyarrow as pa

    from domweave.functions.urls import resolve_lists

    lists = pa.array([["x", "http://"], None, [], ["y"] * 9000, *[["z"]] * 20_000], pa.list_(pa.string()))
    found = [x.to_pylist() for x in resolve_lists(iter([(pa.array([URL] * len(lists)), lists)]))]
    assert [x for part in found for x in part][:3] == [["https://example.com/x", "http://"], None, []]
    assert sum(map(len, found)) == len(lists) and all(len(x) == 1 or sum(len(y or []) for y in x) <= 4096 for x in found)


def test_an_element_is_looked_up_once(spark, page):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    stored = heal.capture(page(OLD), ["u"])
    assert plan(stored).count("tag = u)") == 1
    # once to tell what is to be scored, and once for what is returned
    assert plan(heal.auto_match(page(NEW), stored, "b")).count("tag = b)") == 2


def test_fingerprints_are_shuffled_once(spark, page):
    stored = heal.capture(page(OLD), ["div"]).unionByName(heal.capture(page(OLD, None), ["div", "span"]))
    pages = spark.createDataFrame([(URL, 1), (None, 2), ("", 3)], "url string, k int")
    met = heal.attach(pages, stored, ["div", "span", "div"])
    # one for the fingerprints and one for the pages
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert {r.k: r["__stored"] and set(r["__stored"]) for r in met.collect()} == {1: {"div"}, 2: {"div", "span"}, 3: None}


def test_records(page):
    df = page("<h2>R1</h2><i>$10</i><h2>R2</h2><h2> </h2>")
    fields = [Field("h", "h2"), Field("i", "i", default="x", transform=F.lower), Field("none", "u", default="D", transform=F.lower), Field("url", "i")]
    assert records.extract(df, fields).drop("html").first().asDict() == {"h": "R1 R2", "i": "$10", "none": "d", "url": "$10"}
    assert records.extract(df, fields[:3], raw=True).drop("html", "url").first()[:] == ("R1 R2 ", "$10", "")
    assert [tuple(r)[2:] for r in records.extract_lists(df, fields[:2]).orderBy("position").collect()] == [(0, "R1", "$10"), (1, "R2", ""), (2, "", "")]
    with pytest.raises(SchemaError):
        records.extract(df, [fields[0], fields[0]])


def test_rules(page):
    df = page("<i>abc</i><b>1.299.99</b><u> /p q </u><s>March 5, 2024</s>")
    rules = [Rule("a", "i", type="price", default="0"), Rule("b", "b", type="price"), Rule("c", "u", type="url"), Rule("d", "s", type="date"), Rule("e", "q", default="none")]
    assert records.apply_rules(df, rules).first()[2:] == ("0", "1299.99", "https://example.com/p%20q", "2024-03-05", "none")
    assert records.apply_rules(df, rules, strict=True).first()[2:4] == ("", "1.299.99")
    with pytest.raises(SchemaError):
        records.apply_rules(df, [Rule("a", "i", type="colour")])


def test_values(spark):
    df = spark.createDataFrame([(" 5 March 2024 ",), ("2024-03-05",), ("03/05/2024",), ("soon ",), ("$1,299.99",), ("1.299.99",), ("",), (None,)], "v string")
    rows = df.select(values.date(F.col("v")).alias("d"), values.price(F.col("v")).alias("p"), values.number(F.col("v")).alias("n")).collect()
    assert [r.d for r in rows] == ["2024-03-05"] * 3 + ["soon", "$1,299.99", "1.299.99", "", None]
    assert [r.p for r in rows][4:] == ["1299.99", "1299.99", "", None] and [r.n for r in rows][4:] == [1299.99, None, None, None]


@pytest.mark.parametrize(
    "kind, value, out, error",
    [
        ("integer", "1,234", "1234", None), ("integer", "12.5", "125", None), ("integer", " abc", "", "Field 'v': value 'abc' is not a valid integer"), ("integer", "", "", None), ("float", "€1.234.56", "1234.56", None),
        ("float", "-", "-", "Field 'v': value '-' is not a valid float"), ("boolean", "YES", "true", None), ("boolean", "no", "false", None), ("boolean", "maybe", None, "Field 'v': value 'maybe' is not a valid boolean"), ("string", " a ", "a", None), ("string", None, "", None),
    ],
)
def test_validators(spark, kind, value, out, error):
    row = records.validate(spark.createDataFrame([(value,)], "v string"), [Constraint("v", kind)]).first()
    assert (row.v, row.error) == (out, error)


def test_validation_stops_at_the_first(spark):
    schema = [Constraint("a", required=True), Constraint("b", "integer"), Constraint("c")]
    df = records.validate(spark.createDataFrame([(" ", "x"), ("1", "x"), ("1", "2")], "a string, b string"), schema)
    assert [r.error and r.error[:12] for r in df.collect()] == ["Required fie", "Field 'b': v", None]
    good, bad = records.good_and_rejects(df)
    assert good.count() == 1 and bad.count() == 2
    assert records.typed(good, schema).first()[:] == ("1", 2, "")


def test_similarity(spark):
    assert sim.jaro_winkler("", "") == 1 and sim.jaro_winkler("a", "") == 0
    assert round(sim.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611 and round(sim.jaro_winkler("DIXON", "DICKSONX"), 4) == 0.8133
    assert sim.jaro_winkler("In Stock", "In Stock, some left") > 0.7
    sets = spark.createDataFrame([(["price", "red"], ["price", "blue"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in sets.select(sim.jaccard(F.col("a"), F.col("b"))).collect()] == [0.3333, 1.0]
    assert sim.ancestor_score([], []) == 1 and sim.ancestor_score([], [{"tag": "a", "id": "", "class": ""}]) == 0


def test_jaro_winkler_against_duckdb():
    import duckdb
    from hypothesis import given, settings
    from hypothesis import strategies as st

    word = st.text(alphabet="abcd", min_size=1, max_size=12)
    con = duckdb.connect()

    @settings(max_examples=300, deadline=None)
    @given(word, word)
    def same(a, b):
        assert abs(sim.jaro_winkler(a, b) - con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-9
        assert abs(sim.jaro_winkler(a, b) - sim.jaro_winkler(b, a)) < 0.2

    same()


OLD = '<html><body><div id="item" class="card"><div class="box"><span class="price">$9</span></div></div></body></html>'
NEW = '<html><body><section><div class="card"><p>x</p><span class="amount">$9</span></div></section></body></html>'


def test_healing(spark, page, tmp_path):
    store = heal.FingerprintStore(spark, str(tmp_path / "store"))
    store.put(heal.capture(page(OLD), ["span.price", "u"]))
    known = store.scan()
    assert known.count() == 1
    assert heal.auto_match(page(OLD), known, "span.price").first()[1:] == (4, "$9", 1.0, False, None)
    found = heal.auto_match(page(NEW), known, "span.price").first()
    assert (found.node_id, found.text, found.healed) == (5, "$9", True)
    # text 1, class 0, ancestors (0.7 + 0 + 1 + 1) / 4 as the card is nearest in class, attributes 0, tag 1, depth 1
    assert round(found.similarity_score, 6) == round((2 + 1.5 * 0.675 + 1 + 0.5) / 7.5, 6)
    lost = heal.auto_match(page(NEW), known, "span.price", weights={"class": 20.0})
    assert "nothing is like" in lost.first().error or lost.first().node_id != 5
    with pytest.raises(MatchError):
        heal.require(heal.auto_match(page(NEW), known, "span.other"))
    matched = heal.auto_match(page(NEW), known, "span.price")
    store.put(heal.refresh(page(NEW), matched, "span.price"))
    assert store.get(URL, "span.price").first().class_list == ["amount"]
    store.delete(URL, "span.price")
    assert store.scan().count() == 0
    assert heal.auto_match(page(""), known, "span.price").first().error is not None


CASES = [
    ("$299.99", "$249.99", "price", None), ("$0", "$5", "price", None), ("Model 12", "Model 13", "price", None), ("In Stock", "Sold Out", "stock", False), ("In Stock", "unavailable", "stock", True),
    ("red", "blue", "content", None), (None, "v", "added", None), ("v", None, "removed", None), ("2 left, in stock", "sold out", "stock", False),
]


def test_changes(spark):
    rows = [(k, "f", o, n) for k, (o, n, *_) in enumerate(CASES)] + [(99, "f", "x", "x")]
    df = spark.createDataFrame(rows, "url int, field string, o string, n string")
    out = change.detect(df.select("url", "field", F.col("o").alias("value")), df.select("url", "field", F.col("n").alias("value"))).orderBy("url").collect()
    assert [(r.change_type, r.in_stock) for r in out] == [c[2:] for c in CASES]
    assert round(out[0].diff_pct, 2) == -16.67 and out[1].diff_pct == 0 and out[5].diff == "- red\n+ blue" and out[6].diff == "+ v" and out[7].diff == "- v"
    labels = spark.createDataFrame([(k,) for k in change.KINDS], "k string").select(change.camel_label(F.col("k"))).collect()
    assert [r[0] for r in labels] == ["ElementAdded", "ElementRemoved", "ContentChange", "StockChange", "PriceChange", "LayoutChange"]


def test_nothing_changes(spark):
    df = spark.createDataFrame([("u", "f", "1")], "url string, field string, value string")
    assert change.detect(df, df).count() == 0 and change.detect(df.limit(0), df.limit(0)).count() == 0


def _site(spark, graph):
    rows = [(f"http://s/{k}", "<title>" + k + "</title>" + "".join(f"<a href='/{v}'>x</a>" for v in vs)) for k, vs in graph.items()]
    return spark.createDataFrame(rows, "url string, html string")


def test_crawl(spark):
    site = _site(spark, {"S": ["A", "B", "dead"], "A": ["C"], "B": ["C", "D"], "C": ["S"], "D": []})

    def run(**kw):
        return [(r.url[-1], r.depth, r.t) for r in crawl.crawl(site, ["http://s/S"], [Field("t", "title")], follow="a", **kw).collect()]

    assert run(depth=2, limit=None) == [("S", 0, "S"), ("A", 1, "A"), ("B", 1, "B"), ("C", 2, "C"), ("D", 2, "D")]
    assert run(depth=0) == [("S", 0, "S")] and len(run(depth=1)) == 3 and [x[0] for x in run(limit=3)] == ["S", "A", "B"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "ü")], "x string, y string")
    for kind in sinks.FORMATS:
        sinks.write(df, str(tmp_path / kind), kind)
        back = spark.read.option("header", True).format(kind).load(str(tmp_path / kind))
        assert back.select("x", "y").first()[:] == ("a", "ü")
        sinks.write_one(df.first(), str(tmp_path / f"one.{kind}"), kind)
    assert (tmp_path / "one.csv").read_text(encoding="utf-8") == "x,y\na,ü\n" or (tmp_path / "one.csv").read_bytes() == "x,y\r\na,ü\r\n".encode()
    assert sinks.write_array(df.union(df), str(tmp_path / "all.json")) == 2 and json.loads((tmp_path / "all.json").read_text(encoding="utf-8")) == [{"x": "a", "y": "ü"}] * 2
    with pytest.raises(ExportError):
        sinks.write_one({}, str(tmp_path / "none.parquet"), "parquet")
    with pytest.raises(ExportError):
        sinks.write(df, str(tmp_path / "x"), "xml")


def test_watch_stream_goes_on_where_it_stopped(spark, tmp_path):
    from domweave.streaming.watch import start, watch_stream

    schema = "url string, field string, value string, ts int"
    seen = {"all": 0, "price": []}
    for batch in ([("u", "f", "1", 1), ("u", "f", "2", 2)], [("u", "f", "2", 3), ("u", "g", "x", 3), ("u", "f", "5", 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = watch_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        on = lambda df: seen.__setitem__("all", seen["all"] + df.count())
        start(stream, on, {"price": lambda df: seen["price"].extend((r.old_value, r.new_value) for r in df.collect())}, checkpoint=str(tmp_path / "state")).awaitTermination()
    assert seen == {"all": 2, "price": [("1", "2"), ("2", "5")]}


def test_watch_stream_keeps_the_keys_of_a_bucket_apart(spark, tmp_path):
    from domweave.streaming import watch

    schema = "a string, b timestamp, c double, ts int, value string"
    stamps = "timestampadd(MICROSECOND, id % 2, timestamp'2024-01-01') AS b"
    source = spark.range(40).selectExpr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '1' END AS a", stamps, "CASE id % 5 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D ELSE double('nan') END AS c", "int(id) AS ts", "string(id % 7) AS value")
    for lo in (0, 20):
        source.where(f"ts >= {lo} AND ts < {lo + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = watch.watch_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["a", "b", "c"], buckets=2)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("ts", "old_value", "new_value")
    want = change.watch(source, ["a", "b", "c"]).select("ts", "old_value", "new_value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    # one state for a bucket, not one for each key
    assert spark.read.format("statestore").load(str(tmp_path / "state")).count() <= 2


def test_page_stream(spark, tmp_path):
    from domweave.streaming.watch import extract_stream, page_stream

    spark.createDataFrame([(1, "u", "<title>t</title>")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "in"))
    out = extract_stream(page_stream(spark, str(tmp_path / "in")), [Field("t", "title")])
    sinks.stream_to(out, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().t == "t"


def test_reach_over_all_rows(spark, tmp_path):
    import bench
    from domweave.plans import catalog

    rng = random.Random(3)
    rows = [(rng.randint(0, 40), rng.randint(0, 60), float(rng.randint(1, 50))) for _ in range(90)] + [(0, 7, 1.0), (1, 7, 2.0)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    near = {}
    for s, p, _ in rows:
        near.setdefault(f"s{s}", set()).add(f"p{p}")
        near.setdefault(f"p{p}", set()).add(f"s{s}")
    want, level = {"s0": 0}, {"s0"}
    for depth in (1, 2, 3):
        level = set().union(*(near[u] for u in level)) - set(want)
        want |= dict.fromkeys(level, depth)
    (name,) = [n for n in bench.NAMES if n.startswith("crawl_reach")]
    assert {(r.url, r.depth) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == set(want.items()) and max(want.values()) == 3


def test_best_element_against_all(spark):
    """The pruned search against scores of every element, on random pages, some of which share a url or have none."""
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "beta", "gamma delta", "$9.99", ""])

    def html(depth=0):
        tag, attrs = rng.choice(["div", "p", "b", "i"]), "".join(f' {a}="{rng.choice(["x", "y", "x y"])}"' for a in ("class", "id", "href") if rng.random() < 0.4)
        inner = "".join(html(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 4 else ""
        return f"<{tag}{attrs}>{word()}{inner}</{tag}>"

    urls = [f"http://s/{k}" for k in range(12)]
    old = with_dom(spark.createDataFrame([(u, f'<u class="x y" href="x">{word()}</u>' + html()) for u in urls] + [(None, "<u>beta</u>")], "url string, html string"))
    new = [(u, html()) for u in [*urls, *urls[:3], None, None, "http://s/none"]]
    stored = heal.capture(old, ["u"])
    weights = {"text": 1.0, "depth": 3.0}
    pages = with_dom(spark.createDataFrame(new, "url string, html string"))
    got = heal.auto_match(pages, stored, "u", weights, 0.3).collect()
    assert len(got) == len(new)
    nodes = pages.select("url", "html", F.col("dom"), F.explode("dom").alias("n")).join(heal.latest(stored).select(F.col("url").alias("u"), F.struct("tag", "text", "depth", "attributes", "class_list", "ancestor_path").alias("f")), F.col("url").eqNullSafe(F.col("u")))
    from domweave.sources.pages import node_text

    parts = {"text": sim.text_similarity(node_text(F.col("dom"), F.col("n")), F.col("f.text")), "class": sim.jaccard(heal.class_list(F.col("n.attrs")), F.col("f.class_list")), "ancestor": sim.ancestor_similarity(heal.ancestor_path(F.col("dom"), F.col("n")), F.col("f.ancestor_path")), "attribute": sim.attribute_similarity(F.col("n.attrs"), F.col("f.attributes")), "tag": sim.tag_score(F.col("n.tag"), F.col("f.tag")), "depth": sim.depth_score(F.col("n.depth"), F.col("f.depth"))}
    scored = nodes.select("url", "html", "n.node_id", *[v.alias(k) for k, v in parts.items()]).withColumn("total", sim.composite({k: F.col(k) for k in parts}, weights))
    best = {}
    for r in scored.collect():
        at = best.get((r.url, r.html))
        if r.total > 0.3 and (at is None or (round(r.total, 9), r.node_id) > at):
            best[r.url, r.html] = (round(r.total, 9), r.node_id)
    want = sorted((u or "", *(best.get((u, h)) or (0, -1))) for u, h in new)
    assert sorted((r.url or "", round(r.similarity_score or 0, 9), -1 if r.node_id is None else r.node_id) for r in got) == want
    assert len(best) > 8


def test_error_detail(spark):
    from domweave.errors import detail

    df = spark.createDataFrame([("Required field 'a' is missing or empty",), ("Field 'b': value 'x' is not a valid integer",), ("nothing is like what 'u' selected",), ("odd",), (None,)], "error string")
    found = [r[0] for r in df.select(detail("error")).collect()]
    assert [f and (f.code, f.stage, f.recoverable) for f in found] == [("REQUIRED_FIELD", "validate", True), ("FIELD_TYPE", "validate", True), ("NO_MATCH", "match", True), ("OTHER", "extract", False), None]


def test_stream_split_counts(spark, tmp_path):
    spark.createDataFrame([("1", ""), ("x", "2"), ("3", "3")], "a string, b string").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("a string, b string").parquet(str(tmp_path / "in"))
    checked = records.validate(rows, [Constraint("a", "integer"), Constraint("b", required=True)])
    query = sinks.stream_split(checked, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state"), "json").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = [p.observedMetrics["records"] for p in query.recentProgress if p.observedMetrics.get("records") and (p.observedMetrics["records"].good or p.observedMetrics["records"].rejects)]
    assert [(c.good, c.rejects) for c in counts] == [(1, 2)]
    assert [r.a for r in spark.read.json(str(tmp_path / "good")).collect()] == ["3"] and spark.read.json(str(tmp_path / "bad")).count() == 2


def test_one_file_of_many_records(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None), ("c", 1)], "x string, y int").coalesce(1)
    assert sinks.write_table(df, str(tmp_path / "t.csv")) == 2
    assert (tmp_path / "t.csv").read_text().splitlines() == ["x,y", '"a,b",', "c,1"]
    assert sinks.write_table(df.limit(0), str(tmp_path / "e.csv")) == 0 and (tmp_path / "e.csv").read_text() == ""
