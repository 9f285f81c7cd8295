"""Substring deduplication by relative Lempel-Ziv factors over distributed reference blocks.

A block is the part of the corpus whose windows of 50 words have their anchors
in it. It is indexed by window: the index has each window's first place. A
document is factored against the places that its windows have there: the match
at each is extended word by word to both sides as far as the texts agree, and
of the matches the parse takes, from left to right, the one that reaches
farthest, also if it began before the boundary of the factor before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domweave.llm.common import shuffle_partitions, spread, written

#: Words of the shortest factor that becomes a duplicate span.
LEAST_WORDS = 50
#: Words of the grams of which the smallest hash in a window routes it to its block.
GRAM = 16
#: Bytes of the input that a block has on the whole.
BLOCK_BYTES = 8_000_000
#: Words that are hashed at once; a longer document is cut into overlapping parts.
CHUNK = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """The 64-bit hashes of the words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows(words: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of `least` words within one part: its start, its hash and its anchor.

    The anchor is the smallest hash of the window's grams, so equal windows have
    equal anchors, and neighbouring windows mostly share theirs.
    """
    n, gram = len(words), min(GRAM, least)
    if n < least:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    back = _powers(_INVERSE, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _powers(_BASE, n), out=sums[1:])
    whole = _mix((sums[least:] - sums[:-least]) * back[: n - least + 1])
    low = _mix(((sums[gram:] - sums[:-gram]) * back[: n - gram + 1]) ^ np.uint64(0x5851F42D4C957F2D))
    width, have = least - gram + 1, 1
    while have < width:
        shift = min(have, width - have)
        low = np.minimum(low[:-shift], low[shift:])
        have += shift
    start = np.flatnonzero(part[: n - least + 1] == part[least - 1 :])
    return start, whole[start], low[start]


def first_places(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (doc, first window, windows, document of the first place, its first window) of a block's windows that a smaller doc_id has.

    The index of the block has, for each window, its first place by (doc,
    start). A run grows while neighbouring windows have neighbouring places.
    """
    run = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
    key = _mix(anchor[run] + hashes * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    repeated = order[np.append(same, False) | np.insert(same, 0, False)] if len(same) else order[:0]
    key, run, inside = key[repeated], run[repeated], inside[repeated]
    of, at = doc[run], start[run].astype(np.int64) + inside
    order = np.lexsort((at, of, key))
    key, of, at = key[order], of[order], at[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    reference = np.flatnonzero(first)[np.cumsum(first) - 1] if len(key) else np.zeros(0, dtype=np.int64)
    other = of != of[reference]
    of, at, ref_of, ref_at = of[other], at[other], of[reference][other], at[reference][other]
    order = np.lexsort((at, of))
    of, at, ref_of, ref_at = of[order], at[order], ref_of[order], ref_at[order]
    begins = np.ones(len(of), dtype=bool)
    begins[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (ref_of[1:] != ref_of[:-1]) | (ref_at[1:] != ref_at[:-1] + 1)
    at_first = np.flatnonzero(begins)
    count = np.diff(np.append(at_first, len(of)))
    return of[at_first], at[at_first], count, ref_of[at_first], ref_at[at_first]


def _blocks_of(docs: DataFrame, blocks: int, least: int) -> DataFrame:
    """Rows of packed runs of windows by block; a run is windows of a document next to each other with one anchor."""

    def pack(ids: list[int], bases: list[int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.cumsum([0] + [len(p) for p in parts])
        start, whole, anchor = windows(np.concatenate(parts), part, least)
        if not len(start):
            return
        of = part[start]
        begins = np.ones(len(start), dtype=bool)
        begins[1:] = (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(begins)
        length = np.diff(np.append(first, len(start)))
        run_of, run_anchor = of[first], anchor[first]
        run_doc = np.array(ids, dtype=np.int64)[run_of]
        run_start = (start[first] - at[run_of] + np.array(bases, dtype=np.int64)[run_of]).astype(np.int64)
        block = (_mix(run_anchor) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        hashes = whole[np.repeat(first[order], length[order]) + np.arange(len(start)) - np.repeat(np.cumsum(length[order]) - length[order], length[order])]
        edges = np.flatnonzero(np.diff(block[order], prepend=-1))
        ends = np.append(edges[1:], len(order))
        window_end = np.cumsum(length[order])
        columns = [run_anchor[order], run_doc[order], run_start[order].astype(np.uint32), length[order].astype(np.uint32)]
        packed = [[c[a:b].tobytes() for a, b in zip(edges, ends)] for c in columns]
        # 48 bits of a window's hash, beside the 64 of its anchor
        for part_of in (hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint16)):
            packed.append([part_of[window_end[a] - length[order][a] : window_end[b - 1]].tobytes() for a, b in zip(edges, ends)])
        yield pa.RecordBatch.from_arrays([pa.array(block[order][edges].astype(np.int32)), *[pa.array(c, pa.binary()) for c in packed]], names=["block", *_PACKED])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, bases, parts, held = Words(), [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or "").split()
                if len(words) < least:
                    continue
                hashed = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                for base in range(0, len(hashed) - least + 1, CHUNK):
                    ids.append(doc_id.as_py())
                    bases.append(base)
                    parts.append(hashed[base : base + CHUNK + least - 1])
                    held += len(parts[-1])
                    if held >= CHUNK:
                        yield from pack(ids, bases, parts)
                        ids, bases, parts, held = [], [], [], 0
        if parts:
            yield from pack(ids, bases, parts)

    chosen = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(emit, "block int, " + ", ".join(f"{c} binary" for c in _PACKED))


_PACKED = ["anchors", "docs", "starts", "lengths", "hashes", "more"]
_TYPES = [np.uint64, np.int64, np.uint32, np.uint32, np.uint32, np.uint16]
_RUN = "start long, end long, ref_doc long, ref_start long"
_ARROW_RUN = pa.list_(pa.struct([(c.split()[0], pa.int64()) for c in _RUN.split(", ")]))


def joined_runs(runs: list[tuple[int, int, int, int]], least: int) -> tuple[list[tuple[int, int, int, int]], bool]:
    """A document's runs of windows as stretches (start, end, ref_doc, ref_start) of words, those that go on in another block made one; and whether any two touch."""
    out: list[tuple[int, int, int, int]] = []
    for at, count, ref, place in sorted(runs, key=lambda r: (r[2], r[3] - r[0], r[0])):
        if out and out[-1][2] == ref and out[-1][3] - out[-1][0] == place - at and out[-1][1] - least + 1 == at:
            out[-1] = (out[-1][0], at + count + least - 1, *out[-1][2:])
        else:
            out.append((at, at + count + least - 1, ref, place))
    out.sort()
    return out, any(b[0] <= a[1] for a, b in zip(out, out[1:]))


def extended(words: list[str], others: list[str], shift: int, least: int) -> list[tuple[int, int]]:
    """The stretches of at least `least` words that agree with the other text, `shift` words on."""
    a, b = max(0, -shift), min(len(words), len(others) - shift)
    if b - a < least:
        return []
    same = np.fromiter(map(eq, words[a:b], others[a + shift : b + shift]), dtype=bool, count=b - a)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    return [(a + int(x), a + int(y)) for x, y in zip(edges[::2], edges[1::2]) if y - x >= least]


def parse(matches: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """The greedy parse of the matches (start, end, ref_doc, ref_start), as spans of factors next to each other.

    From a boundary on, the match that covers it and reaches farthest is the
    next factor; of several the one with the smallest reference. A factor is
    cut where the one before it ended, though the match began earlier.
    """
    spans: list[list[tuple[int, int, int, int]]] = []
    at, k, best = -1, 0, None
    order = sorted(matches)
    while True:
        while k < len(order) and order[k][0] <= at:
            if best is None or (-order[k][1], order[k][2:]) < (-best[1], best[2:]):
                best = order[k]
            k += 1
        if best is not None and best[1] > at:
            cut = max(0, at - best[0])
            factor = (best[0] + cut, best[1], best[2], best[3] + cut)
            if spans and spans[-1][-1][1] == factor[0]:
                spans[-1].append(factor)
            else:
                spans.append([factor])
            at = best[1]
        elif k < len(order):
            at = order[k][0]
        else:
            return spans


def factors(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, first_ref, span): the duplicate passages of each document as arrays of factors (start, end, ref_doc, ref_start), in words.

    `first_ref` is the smallest doc_id that has the passage's first window.
    """
    spark = docs.sparkSession
    # so many that one is held by a task at a time, whatever the number of tasks
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    blocks = max(shuffle_partitions(spark), min(-(-size // BLOCK_BYTES), 2**20))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(held: list[list[bytes]]) -> pa.RecordBatch:
            arrays = [np.frombuffer(b"".join(x), dtype=t) for x, t in zip(zip(*held), _TYPES)]
            hashes = arrays[4] | arrays[5].astype(np.uint64) << np.uint64(32)
            found = first_places(*arrays[:3], arrays[3].astype(np.int64), hashes)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["doc_id", "start", "count", "ref_doc", "ref_start"])

        block, held = None, []
        for batch in batches:
            for k, of in enumerate(batch.column(0).to_pylist()):
                if of != block and held:
                    yield places(held)
                    held = []
                block = of
                held.append([batch.column(c)[k].as_py() for c in _PACKED])
        if held:
            yield places(held)

    packed = _blocks_of(docs, blocks, least).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block")
    found = packed.mapInArrow(index, "doc_id long, start long, count long, ref_doc long, ref_start long")
    by_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "ref_doc", "ref_start")).alias("runs"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [joined_runs([tuple(r.values()) for r in runs.as_py()], least) for runs in batch.column(1)]
            columns = [batch.column(0), pa.array([[dict(zip(("start", "end", "ref_doc", "ref_start"), r)) for r in m[0]] for m in made], _ARROW_RUN), pa.array([m[1] for m in made], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "touching"])

    runs = written(by_doc.mapInArrow(join, f"doc_id long, runs array<struct<{_RUN.replace(' ', ':').replace(',:', ',')}>>, touching boolean"), "runs")
    # a stretch that touches no other ends where its texts part; where some touch, the texts are compared
    alone = runs.where("NOT touching").select("doc_id", F.explode("runs").alias("r")).select("doc_id", F.col("r.ref_doc").alias("first_ref"), F.array("r").alias("span"))
    others = runs.where("touching")
    each = others.select("doc_id", F.explode("runs").alias("r"))
    pairs = each.groupBy("doc_id", F.col("r.ref_doc").alias("ref_doc")).agg(F.collect_set(F.col("r.ref_start") - F.col("r.start")).alias("shifts"))
    needed = pairs.select("doc_id").unionByName(pairs.select(F.col("ref_doc").alias("doc_id"))).distinct()
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(needed, "doc_id", "left_semi"), "texts")
    compared = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("ref_doc"), F.col("text").alias("ref_text")), "ref_doc")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, str, list[str]] = (None, "", [])
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                doc_id, ref, shifts, text, ref_text = (batch.column(c)[k].as_py() for c in range(5))
                if (ref, ref_text) != known[:2]:
                    known = (ref, ref_text, ref_text.split())
                words = text.split()
                rows += [(doc_id, a, b, ref, a + s) for s in shifts for a, b in extended(words, known[2], s, least)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "end", "ref_doc", "ref_start"])

    matches = compared.select("doc_id", "ref_doc", "shifts", "text", "ref_text").mapInArrow(extend, f"doc_id long, {_RUN}")
    matches = matches.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "ref_doc", "ref_start")).alias("matches"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, runs, found in zip(*(c.to_pylist() for c in batch.columns)):
                first = {r["start"]: r["ref_doc"] for r in runs}
                rows += [(doc_id, first.get(span[0][0]), [dict(zip(("start", "end", "ref_doc", "ref_start"), f)) for f in span]) for span in parse([tuple(m.values()) for m in found])]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], _ARROW_RUN)], names=["doc_id", "first_ref", "span"])

    parsed = others.join(matches, "doc_id").select("doc_id", "runs", "matches").mapInArrow(cover, alone.schema)
    return alone.unionByName(parsed)


def duplicate_spans(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, ref_doc_id, n_factors): passages that an earlier document holds.

    The spans are the words in windows of `least` words that also occur in a
    document with a smaller doc_id; ref_doc_id is the smallest that has the
    first of them. They are covered by `n_factors` factors of the greedy parse
    (`factors`): a copy of a document is one, in any number of blocks and
    tasks. Windows are equal by their anchor's 64 and their own 48 bits. Each
    is sent to the one block that can hold its equals, so nothing is compared
    that can't match and no block is sent to all documents. Words are what
    white space separates.

    Defined results: null and empty texts, those of fewer than `least` words and
    rows with a null doc_id have no spans; very long texts are hashed in parts
    that overlap; rows that share a doc_id are one document, whose repeats
    don't count; of copies the one with the smallest doc_id is the reference;
    an empty table gives an empty table. Other columns are not read, so their
    names can't clash.
    """
    span = factors(docs, least)
    start, end = F.col("span")[0]["start"], F.element_at("span", -1)["end"]
    return span.select("doc_id", start.alias("start_word"), end.alias("end_word"), (end - start).alias("n_words"), F.col("first_ref").alias("ref_doc_id"), F.size("span").cast("long").alias("n_factors"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All passages of at least `LEAST_WORDS` words that an earlier document holds; their factors are tested by brute force."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return duplicate_spans(docs).drop("n_factors")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS w FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + {LEAST_WORDS}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {LEAST_WORDS - 1}, 0))) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS ref FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
dup AS (SELECT win.doc_id, i, ref FROM win JOIN f USING (h) WHERE ref < win.doc_id),
b AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LEAST_WORDS} THEN 0 ELSE 1 END AS new FROM dup),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b)
SELECT doc_id, min(i)::BIGINT AS start_word, (max(i) + {LEAST_WORDS})::BIGINT AS end_word, (max(i) - min(i) + {LEAST_WORDS})::BIGINT AS n_words, arg_min(ref, i) AS ref_doc_id
FROM s GROUP BY doc_id, span
"""
