"""Changes in a stream of observations, and records from a stream of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from domweave.operators.change import _finished, classified
from domweave.operators.records import Field, extract
from domweave.sources.pages import with_dom


def page_stream(spark, path: str, schema: str = "page_id bigint, url string, html string", files_per_trigger: int | None = None) -> DataFrame:
    """Pages from a folder of Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def extract_stream(pages: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """As in batch, and the time of each record in `extracted_at`."""
    return extract(with_dom(pages), fields).drop("html").withColumn("extracted_at", F.current_timestamp())


#: Keys share a state by the hash of their text, in so many groups.
BUCKETS = 1024


def _key_text(c: Column, kind: str) -> Column:
    """A key as a string, different for different ones."""
    if kind == "timestamp":
        return F.unix_micros(c).cast("string")
    if kind == "binary":
        return F.hex(c)
    if kind in ("float", "double"):
        return F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c).cast("string")
    if kind.startswith(("struct", "array")):
        return F.to_json(F.struct(c), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return c.cast("string")


def _packed(last: dict[str, str]) -> bytes:
    """Keys and values as the bytes of an Arrow stream, which `_unpacked` reads."""
    table = pa.table({"key": pa.array(last.keys(), pa.large_string()), "last": pa.array(last.values(), pa.large_string())})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(state: bytes) -> dict[str, str]:
    table = pa.ipc.open_stream(state).read_all()
    return dict(zip(table["key"].to_pylist(), table["last"].to_pylist()))


def watch_stream(observations: DataFrame, keys: Sequence[str] = ("url", "field"), order: Sequence[str] = ("ts",), value: str = "value", buckets: int = BUCKETS) -> DataFrame:
    """The changes from each observation of a key to the next, with the last value as state; the first emits nothing.

    Within a batch observations are taken by `order`; one that comes in a later
    batch counts as later. Kinds and differences are computed as in batch.
    A state holds the last values of all keys of a bucket, as a call for each
    key would cost far more than its rows; a batch's rows of one bucket are
    held at once. A checkpoint goes on only with the number of buckets that it
    was begun with.
    """
    text = F.col(value).cast("string")
    rows = observations.where(text.isNotNull()).select(*keys, *order, text.alias("new_value"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*keys, *order, "old_value", "new_value"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *order]) + ", old_value string, new_value string"
    longest = max(map(len, rows.columns))
    key, bucket = "__key".ljust(longest + 1, "_"), "__bucket".ljust(longest + 1, "_")

    def follow(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values([key, *order], kind="stable", ignore_index=True)
        last = _unpacked(state.get[0]) if state.exists else {}
        held, values = rows[key].tolist(), rows["new_value"].tolist()
        old = []
        for k, v in zip(held, values):
            old.append(last.get(k))
            last[k] = v
        rows["old_value"] = pd.Series(old, dtype=object)
        state.update((_packed(last),))
        yield rows.loc[rows["old_value"].notna() & (rows["old_value"] != rows["new_value"]), names]

    named = rows.withColumn(key, F.to_json(F.array(*[_key_text(F.col(f"`{c}`"), kinds[c]) for c in keys])))
    grouped = named.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy(bucket)
    changed = grouped.applyInPandasWithState(follow, schema, "last binary", "append", GroupStateTimeout.NoTimeout)
    return _finished(classified(changed), [*keys, *order])


def start(changes: DataFrame, on_change: Callable[[DataFrame], None] | None = None, handlers: Mapping[str, Callable[[DataFrame], None]] | None = None, interval: str | None = None, checkpoint: str | None = None):
    """Starts the stream: every batch's changes go to `on_change`, then those of each kind to its handler. Without an interval what is there is taken and the query ends."""

    def route(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if on_change:
                on_change(batch)
            for kind, handler in (handlers or {}).items():
                handler(batch.where(F.col("change_type") == kind))
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(route).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
