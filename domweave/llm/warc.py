"""A content-addressed archive of WARC records."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domweave.llm.common import new_path, shuffle_partitions, unused

_END = b"\r\n\r\n"
_PIECE = 1 << 16
#: Records of one payload from which it is copied, so that several tasks reconstruct them; each then does so many.
HOT = 50_000

_PAYLOADS = "digest string, payload binary, n_bytes long, mark long"


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, header, payload): the WARC response record of each page, without what ends it.

    The header is that of the record and of the HTTP response. A null url has no
    WARC-Target-URI; a null html has a null payload and a record of no payload.
    """
    body = F.col("html").cast("binary")
    size = F.coalesce(F.length(body), F.lit(0))
    url = F.coalesce(F.col("url"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), url).cast("binary"))
    uuid_ = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid_,
        F.when(F.col("url").isNotNull(), F.concat(F.lit(">\r\nWARC-Target-URI: "), url)).otherwise(">"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.length(http) + size).cast("string"), F.lit("\r\n\r\n"), http,
    )
    return pages.select("page_id", record.cast("binary").alias("header"), body.alias("payload"))


def split_records(data: bytes) -> Iterator[tuple[int, bytes, bytes | None, str | None]]:
    """(offset, header, payload, error) of each record of an uncompressed WARC file.

    The header ends after the HTTP header of a response or request, else after
    the record's own. A record that is cut off ends the file. One whose length
    can't be told is given as it stands up to the next record, as a header
    with an error and no payload.
    """
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(_END, at)
        if not data.startswith(b"WARC/", at) or end < 0:
            return
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in data[at:end].split(b"\r\n")[1:]))
        begin, length = end + 4, fields.get(b"content-length", b"")
        if not length.isdigit():
            after = data.find(_END + b"WARC/", begin - 4)
            stop = after if after >= 0 else len(data)
            yield at, data[at : max(stop, end)], None, "Content-Length is missing" if not length else "Content-Length is no number"
            at = max(stop, end) + 4
            continue
        size = int(length)
        if begin + size > len(data):
            return
        cut = begin
        if fields.get(b"content-type", b"").startswith(b"application/http"):
            inner = data.find(_END, begin, begin + size)
            cut = inner + 4 if inner >= 0 else begin + size
        yield at, data[at:cut], data[cut : begin + size], None
        at = begin + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, header, payload, error) of the records in WARC files, plain or gzipped by record; offsets are of plain bytes.

    A file is one value, so it has at most 2 GB, and so has what a gzipped one
    holds. `error` is null but for records of no known length.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gunzipped(data)
                rows = list(zip(*split_records(data))) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows[0]), pa.string()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.string())],
                    names=["file", "offset", "header", "payload", "error"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, offset long, header binary, payload binary, error string")


def gunzipped(data: bytes) -> bytes:
    """All members; one that is cut off gives what it has. What follows the last member and is none is left out; a damaged member is an error."""
    out, at, view = [], 0, memoryview(data)
    while True:
        while data[at : at + 1] == b"\0":
            at += 1
        if data[at : at + 2] != b"\x1f\x8b":
            return b"".join(out)
        member = zlib.decompressobj(31)
        while at < len(data) and not member.eof:
            piece = view[at : at + _PIECE]  # so that what is unused stays short
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)


def _whole(header: Column, payload: Column) -> Column:
    return F.concat(header, F.coalesce(payload, F.lit(b"")), F.lit(_END))


def distinct_payloads(records: DataFrame) -> DataFrame:
    """(digest, payload, n_bytes, mark): each payload once; that two of one digest differ is an error.

    Copies are told by digest, length and a second, independent hash; they are
    brought together before they move.
    """
    held = records.where("payload IS NOT NULL").select(F.sha2("payload", 256).alias("digest"), "payload", F.length("payload").cast("long").alias("n"), F.xxhash64("payload").alias("mark"))
    one = held.groupBy("digest").agg(F.any_value("payload").alias("payload"), *[f(c).alias(f"{w}_{c}") for c in ("n", "mark") for w, f in (("min", F.min), ("max", F.max))])
    same = (F.col("min_n") == F.col("max_n")) & (F.col("min_mark") == F.col("max_mark"))
    return one.select("digest", _verified(same, F.col("payload")).alias("payload"), F.col("min_n").alias("n_bytes"), F.col("min_mark").alias("mark"))


def _verified(same: Column, payload: Column) -> Column:
    return F.when(same, payload).otherwise(F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("digest"))).cast("binary"))


@dataclass(frozen=True)
class Archive:
    """Two tables in a folder: each payload once, in buckets of its digest, and each record's exact header with the digest of its payload."""

    spark: SparkSession
    path: str

    @property
    def buckets(self) -> int:
        """Read from the folder, where the first call to `append` put it; of a new folder the session's number of shuffle partitions."""
        try:
            return int(self.spark.read.schema("buckets int").json(f"{self.path}/settings").first()[0])
        except AnalysisException:
            number = shuffle_partitions(self.spark)
            self.spark.createDataFrame([(number,)], "buckets int").coalesce(1).write.json(f"{self.path}/settings")
            return number

    def _bucketed(self, name: str) -> None:
        where = f"{self.path}/payloads".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({_PAYLOADS}) USING parquet OPTIONS (path '{where}', compression 'zstd') CLUSTERED BY (digest) INTO {self.buckets} BUCKETS")

    @property
    def payloads(self) -> DataFrame:
        """(digest, payload, n_bytes, mark); the catalog has a name for it only while the plan is made."""
        name = f"payloads_{uuid.uuid4().hex}"
        self._bucketed(name)
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    @property
    def headers(self) -> DataFrame:
        """(key, header, digest, record_digest); key is a struct of the records' key columns."""
        return self.spark.read.parquet(f"{self.path}/headers")

    def append(self, records: DataFrame) -> Archive:
        """Stores records; payloads that are there already, of this call or an earlier one, aren't stored again.

        Every payload moves once, to its bucket, after copies in a task have
        become one; the stored payloads aren't read but for their digests,
        lengths and second hashes, and don't move. Headers don't move at all.
        """
        keys = [F.col(f"`{c}`") for c in records.columns if c not in ("header", "payload")]
        # an empty struct can't be stored
        key = F.struct(*keys) if keys else F.struct(F.lit(None).cast("string").alias("none"))
        known = self.payloads.select("digest", F.col("n_bytes").alias("stored_bytes"), F.col("mark").alias("stored_mark"))
        fresh = distinct_payloads(records)
        if shuffle_partitions(self.spark) != self.buckets:
            fresh = fresh.repartition(self.buckets, "digest")
        met = fresh.join(known.hint("merge"), "digest", "left")
        same = F.col("stored_bytes").isNull() | (F.col("stored_bytes") == F.col("n_bytes")) & (F.col("stored_mark") == F.col("mark"))
        new = met.withColumn("payload", _verified(same, F.col("payload"))).where("payload IS NOT NULL AND stored_bytes IS NULL").select("digest", "payload", "n_bytes", "mark")
        name = f"payloads_{uuid.uuid4().hex}"
        self._bucketed(name)
        try:
            new.write.insertInto(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
        record_digest = F.sha2(_whole(F.col("header"), F.col("payload")), 256)
        stored = records.select(key.alias("key"), "header", F.sha2("payload", 256).alias("digest"), record_digest.alias("record_digest"))
        stored.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/headers")
        return self


def archive(records: DataFrame, path: str | None = None) -> Archive:
    """Stores records (any key columns, header, payload) by content, under `path` or in the shared folder.

    A payload's address is its SHA-256, verified by its length and a second
    hash against every other payload of that address. The header's row keeps
    the key columns, the exact header and the SHA-256 of the whole record. Where
    the folder holds an archive, the records are added to it; any later session
    may go on with it (`Archive(spark, path)`).

    Defined results: a null payload has no address and the record is its header
    alone; an empty payload is stored like any other; very long payloads are
    values of up to 2 GB; repeated records each have a header; a null header
    gives a null record, which is never exact; no records give empty tables.
    Key columns may have any names, the archive's own too, as they are kept in
    a struct; those of a later call must be of the same names and types.
    """
    spark = records.sparkSession
    return Archive(spark, (path or new_path(spark, "archive")).rstrip("/")).append(records)


def reconstruct(store: Archive, hot: int = HOT) -> DataFrame:
    """The key columns, digest, n_bytes, record, record_digest and `exact`: whether the record's bytes have the digest of the original and the payload its address.

    Headers join the payloads' buckets, which don't move. A payload that more
    than `hot` records have is copied so often that no task reconstructs more
    than that of it. Of the five columns those that a key column is named like
    get underscores after their names.
    """
    headers, payloads = store.headers, store.payloads.select("digest", "payload", "n_bytes")
    often = headers.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select("digest", F.ceil(F.col("__n") / hot).cast("int").alias("__parts"))
    often = often.sparkSession.createDataFrame(often.collect(), often.schema) if often.count() <= 10_000 else often
    salted = headers.join(often, "digest", "left").withColumn("__salt", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64("record_digest", F.rand(7)), F.col("__parts")).cast("int")))
    cold = salted.where("__salt IS NULL").join(payloads.hint("merge"), "digest", "left")
    copies = payloads.join(often, "digest").select("digest", "payload", "n_bytes", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__salt"))
    warm = salted.where("__salt IS NOT NULL").join(copies, ["digest", "__salt"])
    columns = ["key", "header", "digest", "record_digest", "payload", "n_bytes"]
    joined = cold.select(*columns).unionByName(warm.select(*columns))
    keys = [c for c in store.headers.schema["key"].dataType.names if c != "none"]
    record = _whole(F.col("header"), F.col("payload"))
    right = (F.sha2(record, 256) == F.col("record_digest")) & F.coalesce(F.sha2("payload", 256) == F.col("digest"), F.col("digest").isNull())
    own = {"digest": F.col("digest"), "n_bytes": F.col("n_bytes"), "record": record, "record_digest": F.col("record_digest"), "exact": F.coalesce(right, F.lit(False))}
    named = joined.select(*[F.col(f"key.`{c}`") for c in keys])
    return joined.select(*[F.col(f"key.`{c}`") for c in keys], *[v.alias(unused(named, c)) for c, v in own.items()])


def op6_warc_archive(spark, sf_dir: str) -> DataFrame:
    """Every page's record, archived by content and reconstructed: its payload's address and size, and the digest of its bytes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = reconstruct(archive(page_records(pages)))
    return back.select("page_id", "digest", "n_bytes", F.sha2("record", 256).alias("record_digest"), F.length("record").cast("long").alias("record_bytes"), "exact")


SQL = r"""
WITH p AS (
  SELECT page_id, html, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
      || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) AS http,
    md5(page_id || ' ' || url) AS m, url, octet_length(encode(html)) AS n FROM pages),
r AS (
  SELECT page_id, html, n, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>'
      || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
      || 'Content-Type: application/http;msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || (length(http) + n)
      || chr(13) || chr(10) || chr(13) || chr(10) || http || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM p)
SELECT page_id, sha256(html) AS digest, n::BIGINT AS n_bytes, sha256(record) AS record_digest,
  octet_length(encode(record))::BIGINT AS record_bytes, true AS exact FROM r
"""
