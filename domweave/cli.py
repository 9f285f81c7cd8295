"""`python -m domweave.cli extract PAGES [URL...]`: what selectors find in a Parquet table of pages (url, html)."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from domweave.api import Session
from domweave.errors import ConfigError
from domweave.operators.heal import FingerprintStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="domweave")
    e = p.add_subparsers(dest="command", required=True).add_parser("extract", help="print what a selector finds; without one, the titles")
    e.add_argument("pages")
    e.add_argument("urls", nargs="*")
    kind = e.add_mutually_exclusive_group()
    for name in ("css", "xpath", "text", "regex"):
        kind.add_argument(f"--{name}")
    e.add_argument("--auto-match", metavar="STORE", help="a folder of fingerprints with which a lost --css selector is mended, and to which what is found is added")
    e.add_argument("--json", action="store_true")
    return p


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("domweave").getOrCreate()
    session = Session(spark, spark.read.parquet(args.pages))
    pages = session.page(*args.urls)
    views = {"css": pages.css, "xpath": pages.xpath, "text": pages.find_text, "regex": pages.regex}
    chosen = next(((k, v) for k in views if (v := getattr(args, k)) is not None), None)
    if args.auto_match and (not chosen or chosen[0] != "css"):
        raise ConfigError("--auto-match needs --css")
    if args.auto_match:
        mending = session.with_(auto_match=True, fingerprints=FingerprintStore(spark, args.auto_match))
        found = mending.dataset(*args.urls).field("texts", chosen[1]).build()
        frame = found.select("url", F.array("texts").alias("texts"))
    else:
        frame = views[chosen[0]](chosen[1]) if chosen else pages.title()
    lines = []
    for row in frame.toLocalIterator():
        lines.append(json.dumps(row.asDict(), ensure_ascii=False) if args.json else f"{row[0]}\t{' | '.join(row[1]) if chosen else row[1]}")
        print(lines[-1])
    return lines


if __name__ == "__main__":
    main()
