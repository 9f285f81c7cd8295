"""Normalisers and validators of extracted strings, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Removes what Unicode calls white space on both sides.
_ENDS = r"(?U)^\s+|\s+$"


def trim(value: Column) -> Column:
    return F.regexp_replace(value, _ENDS, "")


def _kept(value: Column, characters: str) -> Column:
    return F.regexp_replace(value, f"[^{characters}]", "")


def _one_point(value: Column) -> Column:
    """All points but the last taken out."""
    head = F.replace(F.regexp_replace(value, r"\.[^.]*$", ""), F.lit("."), F.lit(""))
    return F.when(F.length(F.regexp_replace(value, r"[^.]", "")) > 1, F.concat(head, F.lit("."), F.substring_index(value, ".", -1))).otherwise(value)


def price(value: Column, one_point: bool = True) -> Column:
    """The digits, points and minus signs; of several points the last stays, or all do."""
    kept = _kept(value, "0-9.\\-")
    return _one_point(kept) if one_point else kept


def date(value: Column) -> Column:
    """The ISO form of `March 5, 2024`, `5 March 2024`, `2024-03-05` and `03/05/2024` in any case, else the trimmed value."""
    plain = trim(value)
    low = F.lower(plain)
    found = F.coalesce(*[F.try_to_timestamp(low, F.lit(f)) for f in ("MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd", "M/d/yyyy")])
    return F.coalesce(F.date_format(found, "yyyy-MM-dd"), plain)


def number(value: Column) -> Column:
    """The number that the digits, points and minus signs make, null if they make none."""
    return _kept(value, "0-9.\\-").try_cast("double")


def is_stock(value: Column) -> Column:
    low = F.lower(value)
    return low.contains("in stock") | low.contains("out of stock") | low.contains("sold out") | low.contains("available")


# validators: (normalised value, whether it is allowed)

def as_string(value: Column) -> tuple[Column, Column]:
    return trim(value), F.lit(True)


def as_integer(value: Column) -> tuple[Column, Column]:
    """The digits and minus signs, which must make a 64-bit integer; blank is allowed."""
    kept = _kept(value, "0-9\\-")
    blank = trim(value) == ""
    return F.when(blank, F.lit("")).otherwise(kept), blank | kept.try_cast("bigint").isNotNull()


def as_float(value: Column) -> tuple[Column, Column]:
    kept = price(value)
    blank = trim(value) == ""
    return F.when(blank, F.lit("")).otherwise(kept), blank | kept.try_cast("double").isNotNull()


def as_boolean(value: Column) -> tuple[Column, Column]:
    low = F.lower(trim(value))
    plain = F.when(low.isin("true", "1", "yes"), "true").when(low.isin("false", "0", "no"), "false").when(low == "", "")
    return plain, plain.isNotNull()


VALIDATORS = {"string": as_string, "integer": as_integer, "float": as_float, "boolean": as_boolean}
