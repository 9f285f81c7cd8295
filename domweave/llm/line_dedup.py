"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from domweave.llm.common import delete, new_path, shuffle_partitions, spread, unused, written

_KEY = ["h1", "h2"]


def _is_blank(line: Column) -> Column:
    return F.translate(line, " \t\r", "") == ""


def line_hashes(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, line_no) for each line that isn't blank; the two 64-bit hashes are independent."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(~_is_blank(F.col("line"))).select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "doc_id", "line_no"
    )


#: The columns of a run, and of the table of runs.
RUN = "h1 long, h2 long, doc_id long, line_no int"
_STATE = "version long, level int, place int, run string, buckets int"
_PLACES = 2**32


def firsts(batch: DataFrame) -> DataFrame:
    """(h1, h2, first, unnamed): of each hash the least of doc_id * 2^32 + line_no, and if a null doc_id has it the negative of its least line_no there."""
    # one number for both, so that equal lines are brought together by hash before they move
    place = F.col("doc_id").cast("decimal(38,0)") * F.lit(_PLACES).cast("decimal(10,0)") + F.col("line_no")
    return batch.groupBy(*_KEY).agg(F.min(place.cast("decimal(38,0)")).alias("first"), F.max(F.when(F.col("doc_id").isNull(), -F.col("line_no"))).alias("unnamed"))


class SortedRuns:
    """Runs of line hashes by level, each a table bucketed and sorted by hash in one folder.

    A batch is anti-joined with every run bucket by bucket, so that no run is
    ever shuffled again. When a level holds `fanout` runs they are merged into
    one run of the next level. Where the folder holds runs already, those are
    gone on with, in any session: `state` there lists, under a number that
    grows, the runs that count.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 3) -> None:
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.buckets, self.version = shuffle_partitions(spark), 0
        self.levels: list[list[str]] = []
        self.stale: list[str] = []
        #: The runs of level 0 that were added through this object.
        self.added: list[str] = []
        try:
            rows = spark.read.schema(_STATE).parquet(f"{self.path}/state")
            self.version = rows.selectExpr("max(version)").first()[0] or 0
        except AnalysisException:  # a new folder
            return
        for r in rows.where(F.col("version") == self.version).orderBy("level", "place").collect():
            while r.level >= len(self.levels):
                self.levels.append([])
            self.levels[r.level].append(r.run)
            self.buckets = r.buckets

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def table(self, run: str) -> DataFrame:
        """The run with its buckets; the catalog has its name only while the plan is made."""
        name = f"run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet OPTIONS (path '{self.path}/{run}') CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _write(self, df: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        name = run.replace("-", "_")
        df.write.option("path", f"{self.path}/{run}").bucketBy(self.buckets, *_KEY).sortBy(*_KEY).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return run

    def add(self, batch: DataFrame) -> None:
        """Adds the batch's hashes that no run has, each with its first position, as a run of level 0."""
        first = firsts(batch)
        fresh = first.repartition(self.buckets, *_KEY) if shuffle_partitions(self.spark) != self.buckets else first
        for run in self.runs():
            fresh = fresh.join(self.table(run).select(*_KEY).hint("merge"), _KEY, "left_anti")
        doc_id = F.floor(F.col("first") / F.lit(_PLACES).cast("decimal(10,0)")).cast("long")
        line_no = F.pmod(F.col("first"), F.lit(_PLACES).cast("decimal(38,0)")).cast("int")
        null = F.col("unnamed").isNotNull()
        run = self._write(fresh.select(*_KEY, F.when(~null, doc_id).alias("doc_id"), F.when(null, -F.col("unnamed")).otherwise(line_no).alias("line_no")))
        self.added.append(run)
        self._push(0, run)

    def _push(self, level: int, run: str) -> None:
        while level >= len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged, *rest = [self.table(r) for r in self.levels[level]]
            for other in rest:
                merged = merged.unionByName(other)
            self.stale += self.levels[level]
            self.levels[level] = []
            self._push(level + 1, self._write(merged.repartition(self.buckets, *_KEY)))

    def save(self) -> None:
        """Makes the runs of now those that the folder is opened with."""
        self.version += 1
        rows = [(self.version, k, n, run, self.buckets) for k, level in enumerate(self.levels) for n, run in enumerate(level)]
        self.spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def vacuum(self) -> None:
        """Removes the runs that were merged into others through this object. Frames made from them can't be read afterwards."""
        for run in self.stale:
            delete(self.spark, f"{self.path}/{run}")
        self.stale = []

    def contents(self, runs: list[str] | None = None) -> DataFrame:
        """All entries, or those of some runs."""
        paths = [f"{self.path}/{run}" for run in (self.runs() if runs is None else runs)]
        reader = self.spark.read.schema(RUN)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], RUN)


def first_positions(docs: DataFrame, batches: int = 6, fanout: int = 3, path: str | None = None) -> tuple[DataFrame, SortedRuns]:
    """(h1, h2, doc_id, line_no): where each distinct line that the runs didn't have comes first, by (doc_id, line_no)."""
    spark = docs.sparkSession
    # about as many documents in each, whatever the ids are
    edges = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = sum((F.coalesce(F.col("doc_id") > e, F.lit(False)).cast("int") for e in sorted(set(edges or []))), F.lit(0))
    hashes = written(line_hashes(docs).withColumn("batch", batch), "lines", "batch")
    runs = SortedRuns(spark, path or new_path(spark, "runs"), fanout)
    for b in range(batches):
        runs.add(hashes.where(F.col("batch") == b).drop("batch"))
    return runs.contents(runs.added), runs


@F.pandas_udf(StringType())  # not a string, which needs a session to be read when the module is imported
def _rebuilt(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    out = []
    for text, keep in zip(texts, keeps):
        if text is None:
            out.append(None)
            continue
        kept = set() if keep is None else set(keep.tolist())
        lines = enumerate(text.split("\n"))
        out.append("\n".join([x for i, x in lines if not x.strip(" \t\r") or i << 32 | xxhash.xxh64_intdigest(x, 42) & 0xFFFFFFFF in kept]))
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, batches: int = 6, fanout: int = 3, path: str | None = None) -> DataFrame:
    """The documents without the lines that an earlier place holds already.

    Of equal lines the one at the smallest (doc_id, line number) stays.
    Batches of ascending doc_id go through levelled sorted runs of line
    hashes (`SortedRuns`); a line stays iff the runs hold its own position.
    With `path` the runs are kept in that folder: the lines of documents that
    went through it in earlier calls or sessions go, and those of this call are
    added when the frame is returned. Without it they are in the shared folder.

    All columns of `docs` are returned, those beyond doc_id and text unread,
    with `text` replaced and `n_chars` recounted where it exists.

    Defined results: null text stays null and has no lines; empty text stays
    empty; very long texts are split like any other; lines of only spaces, tabs or carriage returns always stay; a null
    doc_id counts as the smallest; rows that share a doc_id count as one
    document, in each of which a line stays if no smaller number has it; an
    empty table gives an empty table.
    """
    id_, kept, new = (unused(docs, c) for c in ("__keep_id", "__keep", "__text"))
    keep, runs = first_positions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches, fanout, path)
    if path:
        runs.save()
    # the line number and half of the line's hash, as rows that share a doc_id may differ at a number
    mark = F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(F.col("h1").bitwiseAND(F.lit(0xFFFFFFFF)))
    keep = keep.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set(mark).alias(kept))
    joined = docs.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    text = _rebuilt(F.col("text"), F.col(kept))
    rest = [F.length(new).cast("long").alias("n_chars") if c == "n_chars" else F.col(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.withColumn(new, text).select(*rest)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its text after line deduplication."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return dedup_lines(docs)


SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents),
ranked AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' OR
    row_number() OVER (PARTITION BY line ORDER BY doc_id, n) = 1 AS keep FROM line),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM ranked WHERE keep GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
