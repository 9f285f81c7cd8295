"""Best-fit decreasing packing of documents into bins of a fixed number of tokens."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domweave.llm.common import spread, token_count, written

#: Tokens that a bin holds.
CAPACITY = 2048
#: Pieces that a slice holds on the whole; equal pieces are ranked within slices, each by one task.
SLICE = 100_000


class CapacityTree:
    """A segment tree over the remaining capacities 0..capacity that counts the open bins of each."""

    def __init__(self, capacity: int) -> None:
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self.size
        while at:
            self.count[at] += bins
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least `least` that some open bin has."""
        at = least + self.size
        if self.count[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan_bins(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: rows (length, from_rank, to_rank, first_bin, per_bin).

    The pieces of one length with ranks in [from_rank, to_rank) go to bins from
    first_bin on, per_bin in each. Pieces of equal length are interchangeable
    and so are bins of equal remaining capacity: a bin that is the tightest for
    a length takes pieces of it until another doesn't fit, before any other bin
    does. So one step serves a whole range of bins, and the result is that of
    placing the pieces one by one.
    """
    tree, open_bins = CapacityTree(capacity), defaultdict(list)
    bins, rows = 0, []

    def put(remaining: int, first: int, number: int) -> None:
        if number:
            open_bins[remaining].append((first, number))
            tree.add(remaining, number)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, number = capacity, bins, -(-left // (capacity // length))
                bins += number
            else:
                first, number = open_bins[room].pop()
                tree.add(room, -number)
            each = room // length
            full = min(number, left // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each))
                put(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if full < number:
                if 0 < left < each:
                    rows.append((length, rank, rank + left, first + full, left))
                    put(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(room, first + full, number - full)
    return rows


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, doc_id, piece, start_token, n_tokens): every token of every document in one bin.

    A document of more than `capacity` tokens is cut into pieces of `capacity`
    and a last one; the pieces are packed by best-fit decreasing. Only the
    number of pieces of each length, at most `capacity` numbers whatever the
    input, goes to the driver, which plans whole ranges of bins (`plan_bins`);
    the pieces find their bins by their rank among those of equal length.
    Ranks are counted in slices, so that no task holds all pieces of a length;
    their number follows from that of the pieces alone, so that the bins don't
    depend on the session's settings. Only the plan is broadcast: some thousand
    rows for a `capacity` of 2,048, whatever the input.

    Defined results: null and empty texts have no tokens and no rows; very long
    texts are cut like any other; a null doc_id is kept; pieces of equal length
    are ranked by slice, doc_id and piece, and repeated rows are each packed;
    an empty table gives an empty table. Other columns are not read, so their
    names can't clash.
    """
    spark = docs.sparkSession
    n, cap = F.col("n"), F.lit(capacity)
    counted = docs.select("doc_id", token_count("text").alias("n")).where("n > 0")
    pieces = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), (F.ceil(n / cap) - 1).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * cap
    pieces = written(pieces.select("doc_id", "piece", start.alias("start_token"), F.least(n - start, cap).cast("int").alias("length")), "pieces")
    slices = max(1, pieces.count() // SLICE)
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    counts = written(pieces.groupBy("length", "slice").agg(F.count("*").alias("number")), "slices")
    by_slice = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "slice", F.coalesce(F.sum("number").over(by_slice), F.lit(0)).alias("offset"))
    lengths = {r.length: r.number for r in counts.groupBy("length").agg(F.sum("number").alias("number")).collect()}
    plan = spark.createDataFrame(plan_bins(lengths, capacity), "length int, from_rank long, to_rank long, first_bin long, per_bin long")
    in_slice = Window.partitionBy("length", "slice").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(in_slice) - 1).join(offsets.hint("merge"), ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("offset"))
    placed = ranked.join(F.broadcast(plan), ["length"]).where("rank >= from_rank AND rank < to_rank")
    bin_id = F.col("first_bin") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("per_bin"))
    return placed.select(bin_id.cast("long").alias("bin_id"), "doc_id", "piece", "start_token", F.col("length").cast("long").alias("n_tokens"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into bins of `CAPACITY` tokens."""
    return pack_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
