"""Exact top-k search by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domweave.llm.common import written

#: Neighbours of each vector.
K = 10
#: Segments of each resolution, coarse to fine; after the last come the vectors themselves.
LEVELS = (4, 8, 16)
#: Vectors of a block, queries of a pack, and queries of a pack that are compared with a block at once.
BLOCK, PACK, CHUNK = 8192, 4096, 64
#: Vectors, the first by hash, around which the others are laid out in blocks, and their dimensions at most.
PIVOTS = 256


def segment_edges(dimension: int, segments: int) -> np.ndarray:
    return np.linspace(0, dimension, min(segments, dimension) + 1).round().astype(int)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, weighted so that the squared distance of two rows is a lower bound of that of their vectors."""
    edges = segment_edges(x.shape[1], segments)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edges[:-1], axis=1) / size
    return np.hstack([mean, np.sqrt(square)]) * np.sqrt(np.tile(size, 2))


def resolutions(x: np.ndarray, levels: Sequence[int] = LEVELS) -> list[np.ndarray]:
    """Statistics of each level that are fewer than the dimensions, and the vectors."""
    return [statistics(x, s).astype(np.float32) for s in levels if 2 * s < x.shape[1]] + [x.astype(np.float32)]


def _near(queries: np.ndarray, bound: np.ndarray, others: np.ndarray, q_levels: list[np.ndarray], o_levels: list[np.ndarray], left: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, exact distance) of all pairs whose distance may be within the query's bound.

    At each resolution a query's pairs beyond its bound are discarded, and
    candidates that no query of the chunk wants are dropped; the slack covers
    the rounding of single precision. `left` gets the pairs left by each level.
    """
    at = np.arange(len(others))
    mask = np.ones((len(queries), len(others)), dtype=bool)
    for level, (q, o) in enumerate(zip(q_levels, o_levels)):
        some = o[at]
        qq, oo = (q.astype(np.float64) ** 2).sum(1), (some.astype(np.float64) ** 2).sum(1)
        limit = bound**2 + 1e-5 * (qq + (oo.max() if len(oo) else 0)) + 1e-9
        least = (-2 * q) @ some.T
        least += oo.astype(np.float32)[None]
        mask &= least <= (limit - qq)[:, None].astype(np.float32)
        if left is not None:
            left[level] += int(mask.sum())
        alive = mask.any(0)
        if not alive.all():
            at, mask = at[alive], mask[:, alive]
        if not len(at):
            break
    i, j = np.nonzero(mask)
    j = at[j]
    distance = np.empty(len(i))
    for a in range(0, len(i), 200_000):
        distance[a : a + 200_000] = np.sqrt(((queries[i[a : a + 200_000]] - others[j[a : a + 200_000]]) ** 2).sum(1))
    return i, j, distance


def _best(i: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each query by (distance, id)."""
    order = np.lexsort((ids, distance, i))
    begins = np.flatnonzero(np.diff(i[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[place < k]


def search(q_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int, left: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, neighbour id, distance): of the others up to k per query within its bound; a vector isn't its own neighbour."""
    q_all, o_all, out = resolutions(queries), resolutions(others), []
    if left is not None:
        left[:] = [0] * len(o_all)
    for a in range(0, len(queries), CHUNK):
        b = slice(a, a + CHUNK)
        i, j, d = _near(queries[b], bound[b], others, [x[b] for x in q_all], o_all, left)
        ok = (ids[j] != q_ids[b][i]) & (d <= bound[b][i])
        i, j, d = i[ok], j[ok], d[ok]
        best = _best(i, ids[j], d, k)
        out.append((i[best] + a, ids[j[best]], d[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def own_bounds(ids: np.ndarray, x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the vectors at some positions the k-th distance within their own block, an upper bound of the k-th of all; infinite in small blocks."""
    bound = np.full(len(at), np.inf)
    if len(x) > k:
        x32, norm = x.astype(np.float32), (x**2).sum(1)
        for a in range(0, len(at), 512):
            some = at[a : a + 512]
            d = norm[some][:, None] + norm[None] - 2 * (x32[some] @ x32.T)
            d[np.arange(len(some)), some] = np.inf
            slack = 1e-5 * (norm[some] + norm.max())
            bound[a : a + 512] = np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0) + slack) + 1e-9
    return bound


def box_bounds(stats: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes): lower bounds of the distances of vectors with these statistics to any vector in the boxes."""
    out = np.zeros((len(stats), len(low)))
    for c in range(stats.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, c] - stats[:, c, None], stats[:, c, None] - high[None, :, c]), 0)
        out += gap**2
    return np.sqrt(out)


def _rows(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _matrix(value, dimension: int, kind: type) -> np.ndarray:
    return np.frombuffer(value, dtype=kind).reshape(-1, dimension).astype(np.float64)


def _finest(dimension: int) -> int:
    """Segments of the finest level whose statistics are fewer than the dimensions, else of the coarsest."""
    return max([n for n in LEVELS if 2 * n < dimension], default=LEVELS[0])


def nearest(vectors: DataFrame, k: int = K, block_size: int = BLOCK, queries: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the exact k nearest, by Euclidean distance, of every vector or of those where `queries` holds.

    Every vector is in a block with others that are nearest to the same pivot,
    by their distance from it. A query's own block gives an upper bound of its
    k-th distance. Blocks whose box of segment statistics is farther than that
    bound never see the query; to the others it is sent, and the blocks
    themselves move once. There lower bounds from segment means and
    deviations, coarse to fine, discard pairs, each by its query's bound, and
    exact distances are computed for those that survive. How many pairs that
    are depends on the vectors: of directions that are spread evenly nearly
    all, of clusters few. Pivots are `PIVOTS` vectors whatever the input; only
    they are given to every task, and only the layout depends on them.

    Defined results: null vectors, vectors with a null or a number that isn't
    finite, those whose dimension isn't the commonest (of equally common ones
    the largest), empty vectors and null ids are left out; rows that share a
    vec_id are one vector, the smallest, and a query if one of them is; ties
    are ordered by neighbor_id; with fewer than k others all are returned; an
    empty table gives an empty table. Other columns are not read but by
    `queries`, so their names can't clash.
    """
    # what moves between executors is as narrow as the input
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    numbers = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    usable = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), asked.alias("asked"))
    common = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension, number = (1, 0) if common is None else (common["d"], common["count"])
    usable = usable.where(F.size("embedding") == dimension)
    # rows that share an id become one; where none do, no row moves for it
    shared = usable.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    if not shared.isEmpty():
        usable = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asked").alias("asked"))
    some = usable.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(PIVOTS).select("embedding").collect()
    pivots = np.array([r.embedding for r in some], dtype=np.float64).reshape(-1, dimension)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("embedding"), dimension)
            d = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
            cell = d.argmin(1)
            radius = np.sqrt(np.maximum(d[np.arange(len(x)), cell], 0))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(radius), *batch.columns], names=["cell", "radius", *batch.schema.names])

    element = usable.schema["embedding"].dataType.simpleString()
    placed = usable.mapInArrow(place, f"cell int, radius double, vec_id long, embedding {element}, asked boolean")
    blocks = max(1, -(-number // block_size))
    placed = placed.repartitionByRange(blocks, "cell", "radius", "vec_id").withColumn("block", F.spark_partition_id())
    finest = _finest(dimension)

    def pack(table: pa.Table) -> pa.Table:
        ids, x, want = table.column("vec_id").to_numpy(), _rows(table.column("embedding").combine_chunks(), dimension), table.column("asked").to_numpy()
        stats = statistics(x, finest)
        at = np.flatnonzero(want)
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": [ids.tobytes()], "x": [x.astype(kind).tobytes()], "low": [stats.min(0).tolist()], "high": [stats.max(0).tolist()],
            "q_ids": [ids[at].tobytes()], "q_x": [x[at].astype(kind).tobytes()], "bounds": [own_bounds(ids, x, at, k).tobytes()],
        })

    schema = "block int, ids binary, x binary, low array<double>, high array<double>, q_ids binary, q_x binary, bounds binary"
    table = written(placed.groupBy("block").applyInArrow(pack, schema), "vectors")
    # queries by the pack and boxes by the pack: each pack of queries meets each pack of boxes once
    asking_all = table.agg(F.sum(F.length("q_ids") / 8)).first()[0] or 0
    per_pack, boxes_per_pack = max(1, int(PACK * blocks // max(1, asking_all))), 4096
    box_packs = -(-blocks // boxes_per_pack)
    asking = table.where(F.length("q_ids") > 0).select(F.explode(F.sequence(F.lit(0), F.lit(box_packs - 1))).alias("box_pack"), "q_ids", "q_x", "bounds", "block")
    boxes = table.select(F.floor(F.col("block") / boxes_per_pack).cast("int").alias("box_pack"), "block", "low", "high")
    boxes = boxes.groupBy("box_pack").agg(F.collect_list(F.struct("block", "low", "high")).alias("boxes"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, bound, x = np.frombuffer(row["q_ids"], dtype=np.int64), np.frombuffer(row["bounds"]), _matrix(row["q_x"], dimension, kind)
                low, high = (np.array([b[c] for b in row["boxes"]]) for c in ("low", "high"))
                near = box_bounds(statistics(x, finest), low, high) <= (bound * (1 + 1e-9) + 1e-6)[:, None]
                out = [(row["boxes"][b]["block"], row["block"], np.flatnonzero(near[:, b])) for b in np.flatnonzero(near.any(0))]
                x = x.astype(kind)
                columns = [[o[0] for o in out], [o[1] for o in out], [q_ids[o[2]].tobytes() for o in out], [x[o[2]].tobytes() for o in out], [bound[o[2]].tobytes() for o in out]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])], names=["block", "source", "q_ids", "q_x", "bounds"])

    sent = asking.join(boxes, "box_pack").select("block", "q_ids", "q_x", "bounds", "boxes").mapInArrow(send, "block int, source int, q_ids binary, q_x binary, bounds binary")
    work = sent.join(table.select("block", "ids", "x"), "block")

    def compare(one: pa.Table) -> pa.Table:
        row = {c: one.column(c)[0].as_py() for c in ("ids", "x")}
        ids, x = np.frombuffer(row["ids"], dtype=np.int64), _matrix(row["x"], dimension, kind)
        asked = [b"".join(one.column(c).to_pylist()) for c in ("q_ids", "q_x", "bounds")]
        q_ids = np.frombuffer(asked[0], dtype=np.int64)
        i, n, d = search(q_ids, _matrix(asked[1], dimension, kind), np.frombuffer(asked[2]), ids, x, k)
        return pa.table({"vec_id": q_ids[i], "neighbor_id": n, "distance": d})

    # a group is a block and the queries of as many other blocks as make a pack
    work = work.withColumn("part", F.floor(F.col("source") / per_pack))
    found = work.groupBy("block", "part").applyInArrow(compare, "vec_id long, neighbor_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "distance")


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The `K` nearest neighbours, among all embeddings, of each whose vec_id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, queries=F.col("vec_id") % 100 == 0).withColumn("distance", F.round("distance", 5))


SQL = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM p)
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, round(d, 5) AS distance FROM r WHERE rank <= {K}
"""
