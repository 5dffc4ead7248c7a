"""Content-addressed web archive: payload bytes once by SHA-256, exact record headers apart, records rebuilt through joins.

write_archive() leaves two Parquet tables in the shared folder: payloads (digest, payload), one row for each distinct
payload, and headers (page_id, digest, header, http), one row for each page with the exact header block of its WARC/1.1 record
and the head of the HTTP response that its block starts with. Records hold type, id (a urn:uuid from the page_id), date, target,
payload digest, content type and length; revisits also the profile, the record they refer to, its target and its date.
Of pages with equal payloads of at least `revisit_bytes` bytes, the one of the largest page_id is a response and the others
are revisits that refer to it; smaller payloads are all responses. read_archive() joins the two, checks each payload
against its digest (a mismatch stops the job), puts the records' bytes together and parses them again. files() gives the
same records as archive files: a warcinfo record, then the records, each a gzip member of its own.

Only digests are grouped; payloads that occur once are written where they are read, without a shuffle, and a payload's
copies are reduced to one on the map side, so a hot payload meets in no task.

Null html: empty payload. A very long one is one like others. Rows with the largest page_id of their payload twice: both are responses. Record
ids are unique: of rows with one page_id, the first read has the id of the page_id, the others ids of their own. Rows without page_id
are archived and returned with null; they are revisits of any numbered page of the same payload. Null or empty url: the target
is the record's own id, and reads back as null. Tabs and line breaks in urls are percent-encoded. As pages hold no time of
capture, all records carry the parameter `date`. Empty table: empty archive. Other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

REVISIT_BYTES, FILE_BYTES = 1000, 64 << 20
DATE = "2000-01-01T00:00:00Z"
#: Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


@dataclass
class Archive:
    payloads: DataFrame
    headers: DataFrame


def _payload() -> Column:
    return F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(" ", *parts))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_END))


def write_archive(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> Archive:
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), _payload().alias("payload")).withColumn("digest", F.sha2("payload", 256))
    place = F.monotonically_increasing_id().alias("place")  # written with the rows, so it does not change when a task runs again
    rows = saved(pages.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"), place))
    uri = F.nullif(F.col("url"), F.lit(""))
    for c in "\t\n\r":
        uri = F.replace(uri, F.lit(c), F.lit(f"%{ord(c):02X}"))
    urn = F.coalesce(_urn(F.col("page_id").cast("string")), F.lit(""))
    urn = F.when(F.col("page_id").isNull(), _urn(F.lit("no page_id"), F.coalesce("url", F.lit("")), F.col("digest"))).otherwise(urn)
    rows = rows.withColumn("urn", urn)
    again = saved(rows.groupBy("urn").agg(F.count("*").alias("rows"), F.min("place").alias("first")).where("rows > 1").select("urn", "first"))
    if not again.isEmpty():
        other = F.col("first").isNotNull() & (F.col("place") != F.col("first"))
        rows = rows.join(again, "urn", "left").withColumn("urn", F.when(other, _urn(F.col("urn"), F.col("place").cast("string"))).otherwise(F.col("urn")))
    rows = rows.withColumn("uri", F.coalesce(uri, F.col("urn")))
    latest = F.when(F.col("page_id").isNotNull(), F.struct("page_id", -F.col("place")))
    last = F.max_by(F.struct("page_id", "urn", "uri"), latest)
    repeated = saved(rows.groupBy("digest").agg(F.count("*").alias("copies"), last.alias("keeper"), F.max("length").alias("size")).where("copies > 1"))

    marked = pages.select("digest", "payload").join(repeated.select("digest", F.lit(True).alias("again")), "digest", "left")
    once = marked.where("again is null").select("digest", "payload")
    first = marked.where("again").groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads = saved(once.union(first), "zstd")

    keeper = repeated.where((F.col("size") >= revisit_bytes) & F.col("keeper").isNotNull()).select("digest", "keeper")
    rows = rows.join(keeper, "digest", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper.page_id"))
    rows = rows.withColumn("http", F.concat(F.lit("HTTP/1.1 200 OK" + _END), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("length").cast("string")), F.lit(_END)))
    refers = F.concat(
        _line("WARC-Profile", F.lit(PROFILE)),
        _line("WARC-Refers-To", F.concat(F.lit("<"), F.col("keeper.urn"), F.lit(">"))),
        _line("WARC-Refers-To-Target-URI", F.col("keeper.uri")),
        _line("WARC-Refers-To-Date", F.lit(date)),
        _line("X-Refers-To-Page-ID", F.col("keeper.page_id").cast("string")),
    )
    header = F.concat(
        F.lit("WARC/1.1" + _END),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), F.col("urn"), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("uri")),
        F.when(revisit, refers).otherwise(""),
        F.coalesce(_line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", (F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("length"))).cast("string")),
        F.lit(_END),
    )
    return Archive(payloads, saved(rows.select("page_id", "digest", header.alias("header"), "http")))


def records(archive: Archive) -> DataFrame:
    """record (its exact bytes) and payload (for revisits the one referred to)."""
    both = archive.headers.join(archive.payloads, "digest")
    right = F.sha2("payload", 256) == F.col("digest")
    both = both.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")))
    body = F.when(F.contains("header", F.lit("WARC-Type: revisit" + _END)), F.lit(b"")).otherwise(F.col("payload"))
    return both.select(F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def read_archive(archive: Archive) -> DataFrame:
    """Per record: record (its exact bytes), and what parsing them gives: page_id, url, record_type, refers_to,
    payload_digest, payload_bytes (for revisits of the payload referred to)."""
    # parse: the header ends at the first empty line, the block has Content-Length bytes, its HTTP head ends alike
    out = records(archive).withColumn("at", F.instr(F.decode("record", "ISO-8859-1"), _END * 2))
    out = out.withColumn("head", F.decode(F.expr("substring(record, 1, at - 1)"), "UTF-8"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    out = out.withColumn("block", F.substring(F.col("record"), F.col("at") + 4, field("Content-Length").cast("int")))
    http = F.instr(F.decode("block", "ISO-8859-1"), _END * 2)
    own = F.substring(F.col("block"), http + 4, F.octet_length("block"))
    full = F.when(field("WARC-Type") == "revisit", F.col("payload")).otherwise(own)
    out = out.withColumn("full", full)
    return out.select(
        "record",
        field("X-Page-ID").cast("long").alias("page_id"),
        F.when(F.concat(F.lit("<"), field("WARC-Target-URI"), F.lit(">")) != field("WARC-Record-ID"), field("WARC-Target-URI")).alias("url"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.sha1("full").alias("payload_digest"),
        F.octet_length("full").cast("long").alias("payload_bytes"),
        (F.concat(F.lit("sha1:"), F.sha1("full")) == field("WARC-Payload-Digest")).alias("digest_matches"),
    )


def files(archive: Archive, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """data: whole .warc.gz files of about file_bytes bytes, or of one record where that is longer. A file's warcinfo id
    follows from its first record: the same records in the same order are the same bytes, also when a task runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"software: content-addressed archive\r\nformat: WARC File Format 1.1\r\n"
        made, size = [], 0
        name = lambda record: uuid.UUID(bytes=hashlib.md5(record).digest(), version=3)

        def put(record: bytes) -> int:
            made.append(gzip.compress(record, 6, mtime=0))
            return len(made[-1])

        for batch in batches:
            for record in (x.as_py() for x in batch.column(0)):
                if not made:
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name(record)}>\r\nWARC-Date: {date}\r\n"
                    size = put(f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n".encode() + about + b"\r\n\r\n")
                size += put(record)
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], names=["data"])
                    made.clear()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], names=["data"])

    return records(archive).select("record").mapInArrow(run, "data binary")
