"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import spread

#: (bytes from which it holds, least ratio, greatest ratio) of whole documents; shorter ones say too little.
BANDS = ((128, 0.40, 1.10), (256, 0.33, 0.95), (512, 0.30, 0.85), (1024, 0.25, 0.80), (4096, 0.20, 0.75), (16384, 0.15, 0.70))
#: (bytes of a document from which it holds, bytes of its chunks, least ratio, greatest ratio of a chunk).
CHUNKS = ((1024, 512, 0.30, 0.95), (4096, 1024, 0.25, 0.90), (16384, 4096, 0.15, 0.85))
#: The share of a document's chunks that may be outside.
OUTSIDE = 0.25
LEVEL = 3

_RESULT = "n_bytes long, ratio double, n_chunks long, chunks_low long, chunks_high long, reason string"


def chunk_ratios(data: bytes, compress, chunk: int) -> list[float]:
    """The ratios of the chunks that cover the data: one after the other, and if the last isn't full, the last `chunk` bytes."""
    starts = list(range(0, len(data) - chunk + 1, chunk))
    if starts and len(data) % chunk:
        starts.append(len(data) - chunk)
    return [len(compress(data[a : a + chunk])) / chunk for a in starts]


def _of_length(table: Sequence[tuple], size: int) -> tuple | None:
    at = bisect_right([row[0] for row in table], size) - 1
    return table[at] if at >= 0 else None


def verdict(text: str | None, compress, bands: Sequence[tuple[int, float, float]] = BANDS, chunks: Sequence[tuple[int, int, float, float]] = CHUNKS) -> tuple:
    """(n_bytes, ratio, n_chunks, chunks_low, chunks_high, reason) of a text; the reason is None if it stays."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = len(data)
    if not size:
        return 0, None, 0, 0, 0, None
    ratio = len(compress(data)) / size
    band, cut = _of_length(bands, size), _of_length(chunks, size)
    parts = chunk_ratios(data, compress, cut[1]) if cut else []
    low, high = sum(p < cut[2] for p in parts), sum(p > cut[3] for p in parts)
    reason = None
    if band and ratio < band[1]:
        reason = "repetitive"
    elif band and ratio > band[2]:
        reason = "incompressible"
    elif low > OUTSIDE * len(parts):
        reason = "repetitive chunks"
    elif high > OUTSIDE * len(parts):
        reason = "incompressible chunks"
    return size, round(ratio, 6), len(parts), low, high, reason


def judge(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS) -> DataFrame:
    """(doc_id, n_bytes, ratio, n_chunks, chunks_low, chunks_high, keep, reason) of every document.

    The ratio is compressed over plain bytes in UTF-8. A document is rejected
    if its whole ratio is outside the band of its length, or if more than
    `OUTSIDE` of its chunks are outside the band of chunks in documents of its
    length (`CHUNKS`). Every byte is in a chunk: where the last isn't full, the
    chunk of that size at the end is measured.

    Defined results: null and empty texts have 0 bytes and no ratio and are
    kept, as is everything shorter than the first band; very long texts are
    measured whole, one at a time; a null doc_id is kept; repeated rows are
    judged alike; an empty table gives an empty table. Other columns are not
    read, so their names can't clash.
    """

    @F.pandas_udf(_RESULT)
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        names = [x.split()[0] for x in _RESULT.split(", ")]
        for texts in parts:
            frame = pd.DataFrame([verdict(t, compress, bands) for t in texts], columns=names, dtype=object)
            yield frame.astype({"n_bytes": "int64", "ratio": "float64", "n_chunks": "int64", "chunks_low": "int64", "chunks_high": "int64"})

    v = docs.select("doc_id", measured("text").alias("v"))
    ratio = F.when(F.col("v.n_bytes") > 0, F.col("v.ratio")).alias("ratio")
    return v.select("doc_id", "v.n_bytes", ratio, "v.n_chunks", "v.chunks_low", "v.chunks_high", F.col("v.reason").isNull().alias("keep"), "v.reason")


def op5_compression_bands(spark, sf_dir: str) -> DataFrame:
    """The documents that the bands keep, with their ratios."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judge(docs).where("keep").drop("reason")
