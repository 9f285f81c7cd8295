"""Pages to records: fields, rules with normalisers, positional zip, and validation against a schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.errors import SchemaError
from domweave.functions.urls import url_join
from domweave.functions.values import VALIDATORS, date, price, trim
from domweave.operators.derive import combined_text, texts
from domweave.operators.select import select


@dataclass(frozen=True)
class Field:
    """A named selector. `transform` maps the final value, the default too."""

    name: str
    selector: str
    kind: str = "css"
    default: str | None = None
    transform: Callable[[Column], Column] | None = None


def _others(pages: DataFrame, dom: str, names: Sequence[str]) -> list[Column]:
    if len(set(names)) < len(names):
        raise SchemaError(f"field names repeat: {list(names)}")
    return [F.col(f"`{c}`") for c in pages.columns if c != dom and c not in names]


def field_value(dom: Column, field: Field, raw: bool = False) -> Column:
    """The trimmed text of all selected elements, else the default, else ''; `raw` leaves out trimming, default and transform."""
    text = F.coalesce(combined_text(dom, select(dom, field.selector, field.kind)), F.lit(""))
    if raw:
        return text
    plain = trim(text)
    value = F.when(plain != "", plain).otherwise(F.lit(field.default or ""))
    return field.transform(value) if field.transform else value


def extract(pages: DataFrame, fields: Sequence[Field], dom: str = "dom", raw: bool = False) -> DataFrame:
    """One record for each page: its other columns, then the fields in their order. A column of a field's name is replaced."""
    values = [field_value(F.col(dom), f, raw).alias(f.name) for f in fields]
    return pages.select(*_others(pages, dom, [f.name for f in fields]), *values)


def extract_lists(pages: DataFrame, fields: Sequence[Field], dom: str = "dom") -> DataFrame:
    """Records by position: the k-th match of each field makes the k-th record (`position` from 0); a missing one is ''."""
    names = [f.name for f in fields]
    lists = [F.transform(texts(F.col(dom), select(dom, f.selector, f.kind)), trim).alias(f"f{k}") for k, f in enumerate(fields)]
    others = _others(pages, dom, [*names, "position"])
    rows = pages.select(*others, F.posexplode(F.arrays_zip(*lists)).alias("position", "__row"))
    return rows.select(*others, "position", *[F.coalesce(F.col(f"__row.f{k}"), F.lit("")).alias(n) for k, n in enumerate(names)])


#: What a rule makes of the text: text, price, date, url or attribute.
RULE_TYPES = ("text", "price", "date", "url", "attribute")


@dataclass(frozen=True)
class Rule:
    """A field with a normaliser. Type `attribute` takes `attribute` of the first element, or the text where none is named."""

    name: str
    selector: str
    kind: str = "css"
    type: str = "text"
    default: str | None = None
    attribute: str | None = None


def apply_rules(pages: DataFrame, rules: Sequence[Rule], dom: str = "dom", url: str = "url", strict: bool = False) -> DataFrame:
    """One record for each page with the rules' normalised values.

    A value that is empty after normalising falls back to the default; with
    `strict` only a page without a match does, a price keeps all its points and
    a URL isn't trimmed first.
    """
    values = []
    for r in rules:
        if r.type not in RULE_TYPES:
            raise SchemaError(f"rule type {r.type!r} isn't one of {RULE_TYPES}")
        chosen = select(dom, r.selector, r.kind)
        text = combined_text(F.col(dom), chosen)
        if r.type == "price":
            clean = price(text, one_point=not strict)
        elif r.type == "date" and not strict:
            clean = date(text)
        elif r.type == "url":
            plain = text if strict else trim(text)
            clean = F.coalesce(url_join(F.col(url), plain), plain)
        elif r.type == "attribute" and r.attribute:
            clean = F.coalesce(F.get(chosen, F.lit(0))["attrs"][r.attribute], F.lit(""))
        else:
            clean = trim(text)
        there = F.size(chosen) > 0 if strict else (F.size(chosen) > 0) & (clean != "")
        values.append(F.when(there, clean).otherwise(F.lit(r.default or "")).alias(r.name))
    return pages.select(*_others(pages, dom, [r.name for r in rules]), *values)


@dataclass(frozen=True)
class Constraint:
    """A field of a schema: type is string, integer, float or boolean."""

    name: str
    type: str = "string"
    required: bool = False


def validate(records: DataFrame, schema: Sequence[Constraint], keep: Sequence[str] = ()) -> DataFrame:
    """The schema's fields of each record, normalised, and `error`: the first failure in the schema's order, null for none.

    A field that the records lack counts as ''. `keep` are columns that are
    passed on unread. A record that fails has the values that could be made.
    """
    values, errors = [], []
    for c in schema:
        if c.type not in VALIDATORS:
            raise SchemaError(f"field type {c.type!r} isn't one of {sorted(VALIDATORS)}")
        raw = F.coalesce(F.col(f"`{c.name}`"), F.lit("")) if c.name in records.columns else F.lit("")
        plain, good = VALIDATORS[c.type](raw)
        blank = trim(raw) == ""
        missing = F.when(blank & F.lit(c.required), F.lit(f"Required field '{c.name}' is missing or empty"))
        wrong = F.when(~blank & ~good, F.concat(F.lit(f"Field '{c.name}': value '"), trim(raw), F.lit(f"' is not a valid {c.type}")))
        values.append(plain.alias(c.name))
        errors.append(F.coalesce(missing, wrong))
    names = [c.name for c in schema]
    return records.select(*[F.col(f"`{k}`") for k in keep if k not in names], *values, F.coalesce(*errors, F.lit(None).cast("string")).alias("error"))


def good_and_rejects(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where("error IS NULL").drop("error"), validated.where("error IS NOT NULL")


def typed(validated: DataFrame, schema: Sequence[Constraint]) -> DataFrame:
    """The valid strings as values of their types; blank is null."""
    kinds = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean"}
    known = {c.name: kinds[c.type] for c in schema}
    return validated.select(*[F.col(f"`{c}`").try_cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in validated.columns])
