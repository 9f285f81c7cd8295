"""The fluent surface, the command line and the entry points."""

import pytest
from pyspark.sql import functions as F

from domweave import api, cli
from domweave.errors import ConfigError, SchemaError
from domweave.operators import heal

OLD = '<html><title> T </title><div class="card"><span class="price"> $9 </span><a href="/b">next</a></div></html>'
NEW = '<html><title>T</title><div class="card"><span class="cost">$9</span></div></html>'


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([("http://s/a", OLD), ("http://s/b", NEW)], "url string, html string")


def test_pages(spark, pages):
    with api.Session(spark, pages, after_extract=(api.upper, api.strip)) as s:
        p = s.page("http://s/a")
        assert p.css("a").first().texts == ["NEXT"] and p.xpath("//span").first().texts == ["$9"] and p.regex("9").count() == 1
        assert p.title().first().title == "T" and p.links().first().links == ["http://s/b"] and p.attr("a", "href").first().href == "/b"
        assert [p.find_text("next").first().texts, p.before_text("next").first().texts] == [["NEXT"], ["$9"]]
        assert s.page().nodes().count() == 9


def test_dataset_heals(spark, pages, tmp_path):
    store = heal.FingerprintStore(spark, str(tmp_path / "store"))
    s = api.Session(spark, pages, auto_match=True, fingerprints=store)
    s.dataset("http://s/a").field("price", ".price").capture()
    moved = pages.where("url = 'http://s/b'").withColumn("url", F.lit("http://s/a"))
    out = s.with_(pages=moved).dataset().field("price", ".price", default="?").field("t", "title").build()
    assert [tuple(r) for r in out.collect()] == [("http://s/a", "$9", "T")]
    assert s.with_(auto_match=False, pages=moved).dataset().field("price", ".price", default="?").build().first().price == "?"
    with pytest.raises(SchemaError):
        s.dataset().build()
    with pytest.raises(ConfigError):
        api.Session(spark, pages.drop("html"))


def test_what_is_found_is_stored(spark, tmp_path):
    """Healing begins by itself: a build stores what it found, and the next one, on changed pages, mends with it."""
    s = api.Session(spark, spark.createDataFrame([("http://s/a", OLD), (None, OLD), ("http://s/a", OLD)], "url string, html string"), auto_match=True, fingerprints=heal.FingerprintStore(spark, str(tmp_path / "store")), after_extract=(api.lower,))
    build = lambda s: sorted(tuple(r) for r in s.dataset().field("price", ".price", default="?").field("t", "//title", "xpath").build().fillna("").collect())
    assert build(s) == [("", "$9", "t"), ("http://s/a", "$9", "t"), ("http://s/a", "$9", "t")]
    moved = s.with_(pages=spark.createDataFrame([("http://s/a", NEW), (None, NEW), ("http://s/z", NEW)], "url string, html string"))
    assert build(moved) == [("", "$9", "t"), ("http://s/a", "$9", "t"), ("http://s/z", "?", "t")]
    scores = {r.url: r.similarity_score for r in s.fingerprints.scan().collect()}
    assert set(scores) == {None, "http://s/a"} and all(0.5 < x < 1 for x in scores.values())


def test_collections(spark, pages):
    p = api.Session(spark, pages).page("http://s/a")
    assert p.collection("div span", where=lambda n: n["attrs"]["class"] == "price", value=lambda n: n["depth"]).first()["items"] == [2]
    assert p.collection("//a", "xpath", where=lambda n: n["trimmed"] == "none").first()["items"] == []


def test_crawl_and_watch(spark, pages):
    s = api.Session(spark, pages)
    found = s.crawl("http://s/a").field("t", "title").follow("a").depth(1).limit(None).build()
    assert [r.url for r in found.collect()] == ["http://s/a", "http://s/b"]
    old, new = (s.dataset(u).field("price", "span").build().withColumn("url", F.lit("x")) for u in ("http://s/a", "http://s/b"))
    assert api.Watch().compare(old, new, ["price"]).count() == 0
    with pytest.raises(ConfigError):
        api.Watch().on("colour", print)


def test_command_line(spark, pages, tmp_path, capsys):
    pages.write.parquet(str(tmp_path / "p"))
    assert cli.main(["extract", str(tmp_path / "p"), "http://s/a", "--css", "span"], spark) == ["http://s/a\t$9"]
    store = ["--auto-match", str(tmp_path / "store"), "--css", ".price"]
    assert cli.main(["extract", str(tmp_path / "p"), "http://s/a", *store], spark) == ["http://s/a\t$9"]
    pages.where("url = 'http://s/b'").withColumn("url", F.lit("http://s/a")).write.parquet(str(tmp_path / "q"))
    assert cli.main(["extract", str(tmp_path / "q"), *store], spark) == ["http://s/a\t$9"]
    with pytest.raises(ConfigError):
        cli.main(["extract", str(tmp_path / "p"), "--text", "x", "--auto-match", "y"], spark)
    assert sorted(cli.main(["extract", str(tmp_path / "p"), "--json"], spark))[0] == '{"url": "http://s/a", "title": "T"}'


def test_entry_points():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and "page_title" in names


def test_entry_points_without_the_training_data_operators(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in ("domweave.llm", "domweave.llm.registry"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it is an ImportError
    assert "page_title" in e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"] and set(e.oracle_sql()) <= set(e.queries())
