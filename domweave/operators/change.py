"""What changed between two snapshots of records, and from one observation to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domweave.functions.values import is_stock, number

#: The kinds of change; layout changes are never found, the name is kept.
KINDS = ("added", "removed", "content", "stock", "price", "layout")
_COLUMNS = ["change_type", "old_price", "new_price", "diff_pct", "in_stock", "diff"]


def classified(changes: DataFrame, old: str = "old_value", new: str = "new_value") -> DataFrame:
    """Adds what kind of change each pair of values is; null stands for a value that isn't there.

    Two values that both make a number are a price change, whatever they are
    about; else those of which one speaks of stock are a stock change.
    """
    o, n = F.col(old), F.col(new)
    a, b = number(o), number(n)
    both = o.isNotNull() & n.isNotNull()
    priced = both & a.isNotNull() & b.isNotNull()
    stock = both & ~priced & (is_stock(o) | is_stock(n))
    kind = F.when(o.isNull(), "added").when(n.isNull(), "removed").when(priced, "price").when(stock, "stock").otherwise("content")
    low = F.lower(n)
    diff = F.when(o.isNull(), F.concat(F.lit("+ "), n)).when(n.isNull(), F.concat(F.lit("- "), o)).otherwise(F.concat(F.lit("- "), o, F.lit("\n+ "), n))
    return changes.withColumns({
        "change_type": kind,
        "old_price": F.when(priced, a),
        "new_price": F.when(priced, b),
        "diff_pct": F.when(priced, F.when(a != 0, (b - a) / a * 100).otherwise(0.0)),
        "in_stock": F.when(stock, low.contains("in stock") | low.contains("available")),
        "diff": diff,
    })


def detect(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("url", "field"), value: str = "value") -> DataFrame:
    """(keys, old_value, new_value, change_type, old_price, new_price, diff_pct, in_stock, diff, similarity_score) of the values that differ.

    One full outer join on the keys, which are expected to be unique in each
    snapshot. A null value counts as not there. The values become '' where
    they are missing.
    """
    a = old.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("string").alias("old_value"))
    b = new.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("string").alias("new_value"))
    both = a.join(b, list(keys), "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return _finished(classified(both), keys)


def _finished(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [F.coalesce(c, F.lit("")).alias(c) for c in ("old_value", "new_value")]
    return found.select(*keys, *values, *_COLUMNS, F.lit(1.0).alias("similarity_score"))


def melt(records: DataFrame, fields: Sequence[str], key: str = "url") -> DataFrame:
    """Records with a column for each field as rows (key, field, value)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
    return records.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.value")


def watch(observations: DataFrame, keys: Sequence[str] = ("url", "field"), order: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """The changes from each observation of a key to the next; the first emits nothing. `order` columns are kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    text = F.col(value).cast("string")
    steps = observations.where(text.isNotNull()).select(*keys, *order, text.alias("new_value"), F.lag(text).over(w).alias("old_value"))
    changed = steps.where("old_value IS NOT NULL AND old_value <> new_value")
    return _finished(classified(changed), [*keys, *order])


def of_kind(changes: DataFrame, *kinds: str) -> DataFrame:
    return changes.where(F.col("change_type").isin(*kinds))


def camel_label(kind: Column) -> Column:
    """The kind in the other spelling: PriceChange, StockChange, ContentChange, LayoutChange, ElementAdded, ElementRemoved."""
    stem = F.initcap(kind)
    return F.when(kind.isin("added", "removed"), F.concat(F.lit("Element"), stem)).otherwise(F.concat(stem, F.lit("Change")))
