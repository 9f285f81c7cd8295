"""Records to files: distributed folders, single files of single records, and streams with a fixed schema."""

from __future__ import annotations

import csv
import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from domweave.errors import ExportError

FORMATS = ("json", "csv", "parquet")


def write(records: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a folder of files, in the order of the columns; CSV has a header in each file."""
    if format not in FORMATS:
        raise ExportError(f"format {format!r} isn't one of {FORMATS}")
    writer = records.write.mode(mode)
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def write_one(record: Row | dict, path: str, format: str = "json") -> None:
    """One record as one local file: a JSON object, CSV of a header and a row, or Parquet of strings."""
    values = record.asDict() if isinstance(record, Row) else dict(record)
    if not values and format == "parquet":
        raise ExportError("Cannot export empty dataset")
    if format == "json":
        Path(path).write_text(json.dumps(values, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    elif format == "csv":
        with Path(path).open("w", encoding="utf-8", newline="") as f:
            csv.writer(f).writerows([list(values), ["" if v is None else v for v in values.values()]])
    elif format == "parquet":
        fields = [pa.field(k, pa.string(), nullable=False) for k in values]
        columns = [pa.array(["" if v is None else str(v)], pa.string()) for v in values.values()]
        pq.write_table(pa.Table.from_arrays(columns, schema=pa.schema(fields)), path)
    else:
        raise ExportError(f"format {format!r} isn't one of {FORMATS}")


def write_array(records: DataFrame, path: str) -> int:
    """All records as one local file, a JSON array, passed through the driver one partition at a time; their number."""
    number = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for number, row in enumerate(records.toLocalIterator(), 1):
            f.write(",\n" * (number > 1) + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
        f.write("]\n")
    return number


def stream_to(records: DataFrame, path: str, checkpoint: str, format: str = "parquet", error: str | None = None):
    """A streaming query that appends to a folder; rows with a value in the `error` column are left out."""
    if format not in FORMATS:
        raise ExportError(f"format {format!r} isn't one of {FORMATS}")
    good = records.where(f"`{error}` IS NULL").drop(error) if error else records
    writer = good.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.option("header", True) if format == "csv" else writer).outputMode("append")


def stream_split(records: DataFrame, good: str, rejects: str, checkpoint: str, format: str = "parquet", error: str = "error"):
    """A streaming query that appends rows without an error to one folder and the others, with it, to another.

    Their numbers are in each progress under the name `records`, as `good` and
    `rejects`. Both folders keep the `error` column. A batch that is done again
    after a failure goes to the same place, so that no row is there twice.
    """
    if format not in FORMATS:
        raise ExportError(f"format {format!r} isn't one of {FORMATS}")
    failed = F.col(f"`{error}`").isNotNull()
    counted = records.observe("records", F.count_if(~failed).alias("good"), F.count_if(failed).alias("rejects"))

    def split(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for path, rows in ((good, batch.where(~failed)), (rejects, batch.where(failed))):
                write(rows, f"{path}/batch={number}", format, "overwrite")
        finally:
            batch.unpersist()

    return counted.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).outputMode("append")


def write_table(records: DataFrame, path: str) -> int:
    """All records as one local CSV file with a header, passed through the driver one partition at a time; without records an empty file. Their number."""
    number = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        for number, row in enumerate(records.toLocalIterator(), 1):
            if number == 1:
                out.writerow(records.columns)
            out.writerow(["" if v is None else v for v in row])
    return number
