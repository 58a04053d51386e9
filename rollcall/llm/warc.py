"""Web archives: writing WARC files and reading them back as a table of chunks.

A payload never has to be in memory as a whole on the way back: a record becomes rows of
(record, chunk number), each with the digest of all bytes so far, so the last row of a
record knows its full length and digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import new_path, settle, settle_counted

#: bytes of one chunk of a payload
CHUNK_BYTES = 1 << 20
#: payload bytes after which a task begins another file
FILE_BYTES = 256 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_NAME = re.compile(rb"^<urn:page:(-?\d+)?>$")


def plan_records(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, lead): every page with what its record will be.

    ``lead`` is the page that a revisit refers to, and NULL for a response: of equal
    payloads of ``least_bytes`` at least, the one with the largest id is the response.
    NULL payloads are empty.  NULL ids refer to others and are never referred to; rows that
    repeat the largest id with its payload are all responses.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload")
    ).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    large = rows.where(F.octet_length("payload") >= least_bytes)
    leads = settle(large.groupBy("sha1").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    joined = rows.join(leads.hint("shuffle_hash"), "sha1", "left")
    return joined.select("page_id", "url", "payload", "sha1", F.when(~F.col("lead").eqNullSafe(F.col("page_id")), F.col("lead")).alias("lead"))


@contextmanager
def _member(sink) -> Iterator[gzip.GzipFile]:
    """One gzip member per record, so that readers can start at any of them."""
    with gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=1, mtime=0) as out:
        yield out


def _write_record(sink, page_id: int | None, url: str | None, payload: str, sha1: str, lead: int | None, date: str) -> int:
    """Write one record; the payload is encoded and compressed piece by piece."""
    pieces = [payload[a : a + CHUNK_BYTES] for a in range(0, len(payload), CHUNK_BYTES)] if len(payload) > CHUNK_BYTES else [payload]
    size = sum(len(p.encode()) for p in pieces)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = "" if page_id is None else page_id
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if lead is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url or 'about:blank')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if lead is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{lead}>"]
    lines.append(f"Content-Length: {len(http) + (size if lead is None else 0)}")
    with _member(sink) as out:
        out.write("\r\n".join([*lines, "", ""]).encode() + http)
        if lead is None:
            for p in pieces:
                out.write(p.encode())
        out.write(b"\r\n\r\n")
    return size


def write_archives(records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> tuple[DataFrame, int]:
    """Write rows of ``plan_records`` to .warc.gz files in a shared folder; returns (path, records) and the number of files.

    Every attempt of a task writes files of its own; the returned table lists those of the
    attempts that count.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sink, path, done, size, made = None, "", 0, 0, []
        for part in parts:
            for at in range(0, part.num_rows, 256):
                for row in zip(*[c.to_pylist() for c in part.slice(at, 256).columns], strict=True):
                    if sink is None:
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        sink, done, size = store.open_output_stream(path, compression=None), 0, 0
                    size += _write_record(sink, *row, date)
                    done += 1
                    if size > FILE_BYTES:
                        sink.close()
                        made.append((path, done))
                        sink = None
        if sink is not None:
            sink.close()
            made.append((path, done))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    return settle_counted(records.select("page_id", "url", "payload", "sha1", "lead").mapInArrow(work, "path string, records bigint"))


def record_chunks(stream, chunk_bytes: int) -> Iterator[tuple]:
    """(record_type, page_id, refers_to, payload size or None, chunk_no, data, bytes so far, digest so far, last) of an archive.

    Holds one chunk at a time.  A file that ends inside a record raises EOFError.
    """
    source = io.BufferedReader(gzip.GzipFile(fileobj=stream))

    def lines() -> Iterator[bytes]:
        while (line := source.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise EOFError("the archive ends inside a header")
            yield line

    def header(some: Iterator[bytes]) -> dict[bytes, bytes]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in some)}

    def page(value: bytes | None) -> int | None:
        found = _NAME.match(value or b"")
        return int(found[1]) if found and found[1] else None

    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        about = header(lines())
        left = int(about[b"content-length"])
        first = list(lines())
        left -= sum(map(len, first)) + 2
        declared = header(first[1:]).get(b"content-length")
        kind = about[b"warc-type"].decode()
        fixed = (kind, page(about.get(b"warc-record-id")), page(about.get(b"warc-refers-to")), about.get(b"warc-payload-digest", b"").decode().rpartition(":")[2], int(declared or 0))
        sha, number, seen = hashlib.sha1(), 0, 0
        while True:
            data = source.read(min(chunk_bytes, left - seen))
            sha.update(data)
            seen += len(data)
            if not data and seen < left:
                raise EOFError("the archive ends inside a payload")
            yield (*fixed, number, data, seen, base64.b32encode(sha.digest()).decode(), seen == left)
            number += 1
            if seen == left:
                break


def read_archives(files: DataFrame, n_files: int, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of archives listed in ``files`` (column path).

    Rows: page_id, record_type, refers_to, stated_digest, stated_bytes (of the full
    payload, as the record says), chunk_no from 0, data, bytes_so_far, digest_so_far, last.  A
    record without a payload has one empty chunk.  ``with_data=False`` leaves data NULL.
    """
    names = ["page_id", "record_type", "refers_to", "stated_digest", "stated_bytes", "chunk_no", "data", "bytes_so_far", "digest_so_far", "last"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for part in parts:
            for path in part.column(0).to_pylist():
                held: list[tuple] = []
                size = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for kind, page, refers, digest, stated, number, data, seen, so_far, last in record_chunks(stream, chunk_bytes):
                        held.append((page, kind, refers, digest, stated, number, data if with_data else None, seen, so_far, last))
                        size += len(data) if with_data else 0
                        if size > 8 * CHUNK_BYTES or len(held) >= 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    schema = (
        "page_id bigint, record_type string, refers_to bigint, stated_digest string, stated_bytes bigint, chunk_no bigint, "
        "data binary, bytes_so_far bigint, digest_so_far string, last boolean"
    )
    return files.select("path").repartition(max(1, n_files)).mapInArrow(work, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and report what is read back: one row per page.

    A response reports the bytes and the digest of its chunks; a revisit, which has no
    payload, those of its headers.
    """
    folder = new_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    files, n = write_archives(plan_records(pages), folder)
    ends = read_archives(files, n, folder, with_data=False).where("last")
    response = F.col("record_type") == "response"
    return ends.select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS lead, count(*) AS n FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(p.h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM lead AND lead IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM lead THEN lead END AS refers_to
FROM p JOIN m ON p.h = m.h
"""
