"""What the operators share: the shared folder, written tables, partition counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domweave.plans.shared import shared_folder

#: A token, for counting: a run of characters other than these four. The same in Java and RE2.
TOKEN = "[^ \\t\\n\\r]+"


#: Paths given out within each `temporary`, the innermost last.
_given: list[list[str]] = []

def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _given:
        _given[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes the folder, if it's there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that operators wrote to the shared folder within it. Their results must have been written by then."""
    _given.append([])
    try:
        yield
    finally:
        for path in _given.pop():
            delete(spark, path)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The frame written to the shared folder and read again; it no longer depends on what made it."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Where the scan gives fewer partitions than there are cores, the rows spread over the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def token_count(text: str | Column) -> Column:
    """Tokens between white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN)), F.lit(0)).cast("long")


def unit_hash(column: str | Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of the value's decimal string; null counts as ''."""
    value = F.col(column) if isinstance(column, str) else column
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of the frame has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
