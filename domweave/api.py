"""A fluent surface over tables of pages: sessions, pages, datasets, crawls and watches.

Everything is lazy until an action; nothing is fetched, as pages come from a
table (url, html). Hooks are column functions, applied in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domweave.errors import ConfigError, SchemaError
from domweave.operators import change, crawl, derive, heal, records
from domweave.operators.records import Field
from domweave.operators.select import select
from domweave.plans.shared import written
from domweave.sources import pages as P
from domweave.sources import sinks
from domweave.streaming.watch import start, watch_stream

Hook = Callable[[Column], Column]


def strip(value: Column) -> Column:
    """White space off both sides; a value that would become empty stays."""
    return _or_kept(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), value)


def upper(value: Column) -> Column:
    return F.upper(value)


def lower(value: Column) -> Column:
    return F.lower(value)


def _or_kept(new: Column, old: Column) -> Column:
    return F.coalesce(F.nullif(new, F.lit("")), old)


def _hooked(hook: Hook) -> Hook:
    return lambda value: _or_kept(hook(value), value)


@dataclass(frozen=True)
class Session:
    """Settings that pages, datasets, crawls and watches share; `with_` gives a changed copy."""

    spark: SparkSession
    pages: DataFrame
    auto_match: bool = False
    fingerprints: heal.FingerprintStore | None = None
    weights: Mapping[str, float] = field(default_factory=dict)
    threshold: float = heal.THRESHOLD
    before_parse: tuple[Hook, ...] = ()
    after_extract: tuple[Hook, ...] = ()

    def __post_init__(self) -> None:
        missing = {"url", "html"} - set(self.pages.columns)
        if missing:
            raise ConfigError(f"the table of pages has no column {sorted(missing)}")
        if not 0 <= self.threshold <= 1:
            raise ConfigError("the threshold is between 0 and 1")

    def with_(self, **changes) -> Session:
        return replace(self, **changes)

    def prepared(self, pages: DataFrame) -> DataFrame:
        """The pages after the hooks before parsing."""
        for hook in self.before_parse:
            pages = pages.withColumn("html", hook(F.col("html")))
        return pages

    def hooked(self, value: Column) -> Column:
        """A value after the hooks that follow extraction."""
        for hook in self.after_extract:
            value = _hooked(hook)(value)
        return value

    def page(self, *urls: str) -> Pages:
        return Pages(self, self.pages.where(F.col("url").isin(*urls)) if urls else self.pages)

    def dataset(self, *urls: str) -> Dataset:
        return Dataset(self, urls)

    def crawl(self, *seeds: str) -> Crawl:
        return Crawl(self, seeds)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        pass


class Pages:
    """Pages with their elements; each view is a frame with the url and one more column."""

    def __init__(self, session: Session, pages: DataFrame) -> None:
        self.session = session
        self.source = session.prepared(pages)
        self.frame = P.with_dom(self.source)

    def _view(self, name: str, value: Column) -> DataFrame:
        return self.frame.select("url", value.alias(name))

    def _texts(self, selector: str, kind: str) -> DataFrame:
        return self._view("texts", F.transform(derive.texts(F.col("dom"), select("dom", selector, kind)), self.session.hooked))

    def collection(self, selector: str, kind: str = "css", where: Hook | None = None, value: Hook | None = None) -> DataFrame:
        """(url, items): of the selected elements those for which `where` holds, each as `value` makes it; both are functions of the element's column."""
        found = select("dom", selector, kind)
        found = F.filter(found, where) if where else found
        return self._view("items", F.transform(found, value) if value else found)

    def css(self, selector: str) -> DataFrame:
        return self._texts(selector, "css")

    def xpath(self, path: str) -> DataFrame:
        return self._texts(path, "xpath")

    def regex(self, pattern: str) -> DataFrame:
        return self._texts(pattern, "regex")

    def find_text(self, text: str) -> DataFrame:
        return self._texts(text, "text")

    def after_text(self, text: str) -> DataFrame:
        return self._texts(text, "after_text")

    def before_text(self, text: str) -> DataFrame:
        return self._texts(text, "before_text")

    def attr(self, selector: str, name: str) -> DataFrame:
        """Of the first element; `attrs` has it of all."""
        return self._view(name, derive.attribute(select("dom", selector), name))

    def attrs(self, selector: str, name: str) -> DataFrame:
        return self._view(name, derive.attributes(select("dom", selector), name))

    def nodes(self) -> DataFrame:
        return P.nodes(self.frame.select("url", "dom"))

    def title(self) -> DataFrame:
        return self._view("title", derive.title(F.col("dom")))

    def text(self) -> DataFrame:
        return self._view("text", derive.page_text(F.col("dom")))

    def markdown(self) -> DataFrame:
        return self._view("markdown", derive.markdown(F.col("dom")))

    def links(self) -> DataFrame:
        return self._view("links", derive.links(F.col("dom"), F.col("url")))

    def images(self) -> DataFrame:
        return self._view("images", derive.images(F.col("dom"), F.col("url")))

    def scripts(self) -> DataFrame:
        return self._view("scripts", derive.scripts(F.col("dom"), F.col("url")))

    def styles(self) -> DataFrame:
        return self._view("styles", derive.styles(F.col("dom"), F.col("url")))

    def tables(self) -> DataFrame:
        return self._view("tables", derive.tables(F.col("dom")))

    def forms(self) -> DataFrame:
        return self._view("forms", derive.forms(F.col("dom")))

    def metadata(self) -> DataFrame:
        return self._view("metadata", derive.metadata(F.col("dom")))


class _Fields:
    def __init__(self, session: Session) -> None:
        self.session = session
        self.fields: list[Field] = []

    def field(self, name: str, selector: str, kind: str = "css", default: str | None = None, transform: Hook | None = None):
        self.fields.append(Field(name, selector, kind, default, transform))
        return self


class Dataset(_Fields):
    """Fields of some pages, or of all."""

    def __init__(self, session: Session, urls: Sequence[str]) -> None:
        super().__init__(session)
        self.urls = tuple(urls)

    def _pages(self) -> DataFrame:
        return self.session.page(*self.urls).frame.select("url", "dom")

    def build(self) -> DataFrame:
        """(url, fields). With auto_match and a store, a CSS field that selects nothing takes the element most like its fingerprint, and what was found, either way, is stored.

        All fields are read in one pass over the pages, each parsed once. With
        auto_match the pass is made at once and the records are kept in the
        shared folder, as the fingerprints are stored from the same rows.
        """
        if not self.fields:
            raise SchemaError("a dataset needs fields")
        session, store = self.session, self.session.fingerprints
        css = list(dict.fromkeys(f.selector for f in self.fields if f.kind == "css"))
        if not (session.auto_match and store and css):
            out = records.extract(self._pages(), self.fields)
            return out.select("url", *[session.hooked(F.col(f"`{f.name}`")).alias(f.name) for f in self.fields])
        source = session.page(*self.urls).source.select("url", "html")
        rows = P.with_dom(heal.attach(source, store.known(), css)).drop("html")
        found = {s: f"__m{k}" for k, s in enumerate(css)}
        rows = rows.select("url", "dom", *[heal.match(F.col("dom"), s, F.col("__stored")[s], session.weights, session.threshold).alias(c) for s, c in found.items()])
        values = []
        for f in self.fields:
            value = records.field_value(F.col("dom"), f)
            if f.kind == "css":
                m = F.col(found[f.selector])
                text = m["text"] if f.transform is None else f.transform(m["text"])
                value = F.when(m["healed"] & (m["text"] != ""), text).otherwise(value)
            values.append(session.hooked(value).alias(f.name))
        made = written(rows.select("url", F.struct(*values).alias("record"), heal.found_fingerprints(rows, found).alias("found")), "records")
        seen = made.select("url", F.explode("found").alias("s")).where("s.f IS NOT NULL")
        store.put(seen.select("url", "s.selector_used", "s.f.*", F.current_timestamp().alias("captured_at"), "s.similarity_score"))
        return made.select("url", "record.*")

    def capture(self) -> Dataset:
        """Stores the fingerprints of what the CSS fields select now."""
        if self.session.fingerprints is None:
            raise ConfigError("the session has no store of fingerprints")
        self.session.fingerprints.put(heal.capture(self._pages(), [f.selector for f in self.fields if f.kind == "css"]))
        return self

    def build_structured(self) -> DataFrame:
        return records.extract_lists(self._pages(), self.fields)

    def save(self, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
        sinks.write(self.build(), path, format, mode)


class Crawl(_Fields):
    """Records of the pages that links lead to."""

    def __init__(self, session: Session, seeds: Sequence[str]) -> None:
        super().__init__(session)
        self.seeds, self.selector, self.kind, self.most, self.steps = tuple(seeds), "", "css", 10, 3

    def follow(self, selector: str, kind: str = "css") -> Crawl:
        self.selector, self.kind = selector, kind
        return self

    def limit(self, number: int | None) -> Crawl:
        self.most = number
        return self

    def depth(self, number: int) -> Crawl:
        self.steps = number
        return self

    def build(self) -> DataFrame:
        out = crawl.crawl(self.session.prepared(self.session.pages.select("url", "html")), self.seeds, self.fields, self.selector, self.kind, self.steps, self.most)
        return out.withColumns({f.name: self.session.hooked(F.col(f"`{f.name}`")) for f in self.fields}) if self.session.after_extract and self.fields else out


class Watch:
    """Changes between snapshots of records, or in a stream of observations (url, field, value, ts)."""

    def __init__(self) -> None:
        self.every: Callable[[DataFrame], None] | None = None
        self.handlers: dict[str, Callable[[DataFrame], None]] = {}

    def on_change(self, handler: Callable[[DataFrame], None]) -> Watch:
        self.every = handler
        return self

    def on(self, kind: str, handler: Callable[[DataFrame], None]) -> Watch:
        if kind not in change.KINDS:
            raise ConfigError(f"{kind!r} isn't one of {change.KINDS}")
        self.handlers[kind] = handler
        return self

    def compare(self, old: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
        return change.detect(change.melt(old, fields), change.melt(new, fields))

    def run(self, observations: DataFrame, interval: str | None = None, checkpoint: str | None = None):
        return start(watch_stream(observations), self.every, self.handlers, interval, checkpoint)
