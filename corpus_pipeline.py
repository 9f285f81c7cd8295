"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Toxic documents go, lines seen before go, of near-duplicates one document
stays, the sources are mixed to their target weights, and what is left is
packed into bins. All stages but the last return the columns of documents.
Every stage takes null values in any column, empty and very long texts, ties,
repeated rows, empty tables and further columns; what it does with them is in
its docstring and that of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domweave.llm.common import delete, new_path, temporary, unused
from domweave.llm.line_dedup import dedup_lines
from domweave.llm.mixing import mix_sources
from domweave.llm.packing import pack_documents
from domweave.llm.simhash import keep_one
from domweave.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic; null and empty texts aren't, and repeated rows are judged alike."""
    return keep_clean(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line once, at its smallest (doc_id, line number). A document that had lines and has none left goes; null and blank texts stay."""
    blank = " \t\r\n"
    had = F.coalesce(F.translate("text", blank, "") != "", F.lit(False))
    mark = unused(docs, "__had")
    left = dedup_lines(docs.withColumn(mark, had))
    return left.where(~F.col(mark) | (F.translate("text", blank, "") != "")).drop(mark)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; repeated rows become one, other texts of a doc_id and null ids stay."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, so that the sources' tokens are in proportion to their square roots.

    A null source is a source. Rows that share a doc_id and source are copied alike.
    """
    id_, source, number, copy = (unused(docs, c) for c in ("__id", "__source", "__copies", "__copy"))
    copies = mix_sources(docs).groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source)).agg(F.max("copies").alias(number))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source))
    joined = docs.join(copies.where(F.col(number) > 0).hint("merge"), same)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(number))).alias(copy)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], each).drop(copy)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, piece, start_token, n_tokens) of what is left; texts without a token are in no bin."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the trained classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. What a stage wrote for itself goes when its result is written, and that when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
