"""Near-duplicates by SimHash with pivot distance tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import spread, unused, written

#: Fingerprints this far apart at most are near-duplicates, of 64 bits; so must be the
#: other 64 bits by twice as much, which takes out the pairs that agree by chance.
RADIUS = 7
#: Reference fingerprints.
PIVOTS = 16
#: What a row that is placed costs, in pairs that are looked at.
PLACING = 20

_WORD = re.compile(r"\w+")
_LOW = 2**63


def _signed(x: int) -> int:
    return x - 2 * _LOW if x >= _LOW else x


def pivot_fingerprints(number: int = PIVOTS) -> list[int]:
    """The reference fingerprints: hashes of their numbers, so that any session has the same."""
    return [xxhash.xxh3_64_intdigest(f"pivot {k}") for k in range(number)]


def agreeing(rows: int, radius: int = RADIUS) -> int:
    """How many of radius + n segments to join on, n of which agree in any near pair: the n of the least work for so many rows."""

    def work(n: int) -> float:
        ways = comb(radius + n, n)
        return ways * rows * (PLACING + rows / 2 / 2 ** (64 * n / (radius + n)))

    return min(range(1, 5), key=work)


def segment_masks(segments: int) -> list[int]:
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


class Fingerprints(dict):
    """Hashes of the words met so far, each expanded into 128 weighted signs when it is used."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h

    def of(self, text: str | None) -> tuple[int, int] | None:
        """Two 64-bit halves; None without a word. A word counts once, weighted by its length, as long ones are rarer."""
        words = sorted(set(_WORD.findall(text.lower()))) if text else []
        if not words:
            return None
        total = np.zeros(128)
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            bits = np.unpackbits(np.frombuffer(b"".join(map(self.__getitem__, some)), dtype=np.uint8).reshape(-1, 16), axis=1)
            weight = np.fromiter(map(len, some), dtype=np.float32, count=len(some))
            total += weight @ (bits.astype(np.float32) * 2 - 1)
        halves = np.packbits(total > 0).view(">i8")
        return int(halves[0]), int(halves[1])


def _text_hash() -> Column:
    return F.xxhash64("text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, a, b): a hash of the text and the fingerprint's halves; documents without a word are left out."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            found = [prints.of(t.as_py()) for t in batch.column(2)]
            some = pa.array([p is not None for p in found])
            halves = [pa.array([p[k] for p in found if p], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some), *halves], names=["doc_id", "h", "a", "b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("h"), "text").mapInArrow(compute, "doc_id long, h long, a long, b long")


def _distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def with_pivot_table(df: DataFrame, number: int = PIVOTS) -> DataFrame:
    """Adds t0, t1, ...: the distances of `a` to the reference fingerprints, eight to a number."""
    pivots, columns = pivot_fingerprints(number), {}
    for k in range(0, number, 8):
        parts = [F.shiftleft(_distance(F.col("a"), F.lit(_signed(p))).cast("long"), 7 * i) for i, p in enumerate(pivots[k : k + 8])]
        packed = parts[0]
        for part in parts[1:]:
            packed = packed.bitwiseOR(part)
        columns[f"t{k // 8}"] = packed
    return df.withColumns(columns)


def near_pairs(prints: DataFrame, radius: int = RADIUS, pivots: int = PIVOTS, agree: int = 2) -> DataFrame:
    """(x, y): the keys of all pairs of rows of `prints` (key, a, b) that are near, x < y; exact.

    Within the radius `agree` of radius + `agree` segments of the fingerprints
    are equal, so rows meet on the values of each so many segments, and a pair
    is taken up where its first equal segments meet. Of the rows that meet, the
    pairs whose distances to some reference fingerprint differ by more than the
    radius are discarded (the triangle inequality), and those left are
    verified. The pairs are the same for any `agree`: more mean more copies of
    a row and fewer that meet by chance.
    """
    masks = segment_masks(radius + agree)
    value = [F.col("a").bitwiseAND(F.lit(_signed(m))) for m in masks]
    meets = [F.struct(F.lit(c[-1]).alias("j"), F.xxhash64(F.lit(k), *[value[i] for i in c]).alias("meet")) for k, c in enumerate(combinations(range(len(masks)), agree))]
    table = with_pivot_table(prints, pivots)
    kept = [c for c in table.columns if c.startswith("t")]
    rows = table.select("key", "a", "b", *kept, F.explode(F.array(*meets)).alias("m")).select("key", "a", "b", *kept, "m.j", "m.meet")
    x, y = rows.alias("x"), rows.alias("y")
    # both sides carry and join on the same columns, so that one shuffle of the rows serves both
    # Spark sizes an explode's rows as those before it, and would broadcast them
    met = x.join(y.hint("merge"), (F.col("x.meet") == F.col("y.meet")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.key") < F.col("y.key")))
    for k in range(pivots):
        at = [F.shiftright(F.col(f"{s}.t{k // 8}"), 7 * (k % 8)).bitwiseAND(F.lit(127)) for s in "xy"]
        met = met.where(F.abs(at[0] - at[1]) <= radius)
    met = met.where((_distance(F.col("x.a"), F.col("y.a")) <= radius) & (_distance(F.col("x.b"), F.col("y.b")) <= 2 * radius))
    differing = F.col("x.a").bitwiseXOR(F.col("y.a"))
    equal_before = sum((F.when((F.col("x.j") > s) & (differing.bitwiseAND(F.lit(_signed(m))) == 0), 1).otherwise(0) for s, m in enumerate(masks)), F.lit(0))
    return met.where(equal_before == agree - 1).select(F.col("x.key").alias("x"), F.col("y.key").alias("y"))


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key of each edge's connected component, by alternating large and small stars.

    Every round is written to the shared folder; a few rounds do, as their
    number grows with the logarithm of a component's diameter. Nothing is
    broadcast, as packed files of numbers are much smaller than their rows in memory.
    """
    edges = written(edges.select(F.col("x").alias("u"), F.col("y").alias("v")), "edges")
    while True:
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small, "edges")
        if edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == before:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))


def _classes(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, a, b) of the documents, and (a, b, stays) of the fingerprints: the (doc_id, h) that stays of the group each is in."""
    prints = written(fingerprints(docs.where("doc_id IS NOT NULL")), "prints")
    first = prints.groupBy("a", "b").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    same = written(first.withColumn("key", F.monotonically_increasing_id()), "same")
    groups = components(near_pairs(same.select("key", "a", "b"), radius, agree=agreeing(same.count(), radius)))
    members = same.join(groups.unionByName(groups.select(F.col("root").alias("key"), "root").distinct()).hint("merge"), "key").select("key", "root", "first")
    stays = members.join(members.groupBy("root").agg(F.min("first").alias("stays")).hint("merge"), "root").select("key", "stays")
    return prints, same.join(stays.hint("merge"), "key", "left").select("a", "b", F.coalesce("stays", "first").alias("stays"))


def duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, duplicate_of): each document that goes, and the one of its group that stays.

    Groups are the connected components of the near pairs; the smallest doc_id
    stays. Documents with equal fingerprints, such as exact copies, are one
    class, so that of a thousand copies one meets the others' neighbours and
    the components are those of classes.

    Defined results: null and empty texts, and texts without a word, are like
    nothing; very long texts are read whole; rows with a null doc_id are left
    out; rows that share a doc_id are documents of their own, told apart by a
    hash of their text, and repeated rows are one; a group's row with the
    smallest doc_id, then hash, stays; an empty table gives an empty table.
    Other columns are not read, so their names can't clash.
    """
    prints, classes = _classes(docs, radius)
    gone = prints.join(classes.hint("merge"), ["a", "b"]).where("doc_id <> stays.doc_id OR h <> stays.h")
    return gone.groupBy("doc_id", "h", "stays").agg(F.count("*")).select("doc_id", F.col("stays.doc_id").alias("duplicate_of"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without near-duplicates: of each group the smallest doc_id stays.

    All columns are kept and may be of any type and name. Rows that share a
    doc_id and have different texts stay, unless they are near-duplicates; of
    rows that share both, one stays: the smallest as JSON. Rows with a null
    doc_id all stay.
    """
    prints, classes = _classes(docs, radius)
    id_, h, hash_, row = (unused(docs, c) for c in ("__gone", "__h", "__hash", "__row"))
    gone = prints.join(classes.hint("merge"), ["a", "b"]).where("doc_id <> stays.doc_id OR h <> stays.h").select(F.col("doc_id").alias(id_), F.col("h").alias(h))
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), "doc_id", _text_hash().alias(hash_))
    left = hashed.join(gone.hint("merge"), (F.col("doc_id") == F.col(id_)) & (F.col(hash_) == F.col(h)), "left_anti")
    # JSON, as maps can't be compared
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"{row}.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]))
    one = left.where("doc_id IS NOT NULL").groupBy("doc_id", hash_).agg(F.min_by(row, others).alias(row))
    return one.select(f"{row}.*").unionByName(left.where("doc_id IS NULL").select(f"{row}.*"))


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document that is a near-duplicate of another, and the one that stays for it."""
    return duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
