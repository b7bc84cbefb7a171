"""Operator 2: WARC archives through a chunked record table.

A payload is never one row: it is (record, chunk number) rows of at most CHUNK bytes, each with the SHA-1 of
the payload up to and with that chunk, so the last row of a record has the digest of the whole. In the archive
a chunk is an HTTP chunk of a ``Transfer-Encoding: chunked`` response, which makes every line of the file one
row, written and read by Spark's own text source: files are committed by the task that wins, and a lost
executor's task is run again. Files are gzip streams, so one file is read by one task, in order.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm.common import materialize, sliced, text_bytes

CHUNK = 64 << 10
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of WARC 1.1
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
CHUNKED = b"Transfer-Encoding: chunked\r\n"
CHUNK_SCHEMA = (
    "page_id long, record_type string, url string, chunk_no long, start long, length long, data binary, "
    "running_digest string, declared_digest string, refers_to long, whole boolean"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page_id}')}>"


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) of records whose payload of at least ``min_bytes`` an earlier page has too.

    The payload is read once for its digest; only digests are shuffled. Rows with a null page_id are always
    responses, and a repeated row of the first page is a response again.
    """
    size = F.octet_length(text_bytes("html"))
    rows = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), F.sha1(text_bytes("html")).alias("digest"), size.alias("size")
    )
    rows = rows.where(F.col("size") >= min_bytes).select("page_id", "digest")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(first, "digest").where("page_id > refers_to").select("page_id", "refers_to").distinct()


def record_lines(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Iterator[bytes]:
    """The lines of one record; joined and ended by CRLF they are the record's bytes."""
    digest = base32(hashlib.sha1(payload).digest())
    body = memoryview(payload)
    head = HTTP_HEAD if refers_to is not None else HTTP_HEAD + CHUNKED
    block = len(head) + 2
    if refers_to is None:
        for at in range(0, len(payload), CHUNK):
            n = min(CHUNK, len(payload) - at)
            block += len(b"%x" % n) + 2 + n + 2
        block += 5
    yield b"WARC/1.1"
    yield b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")
    yield b"WARC-Record-ID: " + record_id(page_id).encode()
    yield b"WARC-Date: 1970-01-01T00:00:00Z"
    yield b"WARC-Target-URI: " + " ".join((url or "urn:page").split()).encode()
    if page_id is not None:
        yield b"Page-Id: %d" % page_id
    yield b"WARC-Payload-Digest: sha1:" + digest.encode()
    if refers_to is not None:
        yield b"WARC-Profile: " + PROFILE.encode()
        yield b"WARC-Refers-To: " + record_id(refers_to).encode()
        yield b"Refers-To-Page-Id: %d" % refers_to
    yield b"Content-Type: application/http; msgtype=response"
    yield b"Content-Length: %d" % block
    yield b""
    yield from head[:-2].split(b"\r\n")
    yield b""
    if refers_to is None:
        for at in range(0, len(payload), CHUNK):
            part = body[at : at + CHUNK]
            yield b"%x" % len(part)
            yield bytes(part)
        yield b"0"
        yield b""
    yield b""
    yield b""


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One record per row of pages (page_id, url, html); null html is an empty payload. Other columns are not read."""
    known = materialize(revisits(pages, min_bytes), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("html"))
    rows = rows.join(known, "page_id", "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            held, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for line in record_lines(*row):
                    held.append(line)
                    size += len(line)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["line"])
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["line"])

    lines = rows.mapInArrow(run, "line binary").select(F.col("line").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class Reader:
    """State of the record at hand while the lines of archives pass by; holds one chunk at most."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.step = self.begin
        self.head: dict[str, str] = {}

    def begin(self, line: bytes) -> None:
        if line.startswith(b"WARC/"):
            self.head, self.step = {}, self.header
        elif line:
            raise ValueError(f"no WARC record starts here: {line[:40]!r}")

    def header(self, line: bytes) -> None:
        if line:
            name, _, value = line.decode().partition(": ")
            self.head[name.lower()] = value
            return
        self.left = int(self.head["content-length"])
        self.chunked, self.sha, self.start, self.number = False, hashlib.sha1(), 0, 0
        self.step = self.http

    def http(self, line: bytes) -> None:
        self.left -= len(line) + 2
        if line.lower() == b"transfer-encoding: chunked":
            self.chunked = True
        if not line:
            self.step = self.size if self.chunked else self.begin
            if not self.chunked:
                self.emit(b"", True)

    def size(self, line: bytes) -> None:
        self.left -= len(line) + 2
        self.want, self.parts, self.have = int(line, 16), [], 0
        self.step = self.data

    def data(self, line: bytes) -> None:
        self.left -= len(line) + 2
        self.parts.append(line)
        self.have += len(line)
        if self.have < self.want:
            self.have += 2  # the line break belongs to the payload
            return
        if self.have > self.want or (not self.want and self.left):
            raise ValueError(f"a chunk of {self.want} bytes has {self.have}")
        if self.want:
            self.emit(b"\r\n".join(self.parts), False)
            self.step = self.size
        else:
            self.emit(b"", True)
            self.step = self.begin

    def emit(self, data: bytes, whole: bool) -> None:
        h = self.head
        revisit = h["warc-type"] == "revisit"
        self.sha.update(data)
        page, refers = h.get("page-id"), h.get("refers-to-page-id")
        self.rows.append((
            None if page is None else int(page), h["warc-type"], h["warc-target-uri"], self.number, self.start, len(data), data,
            None if revisit else base32(self.sha.digest()), h["warc-payload-digest"].removeprefix("sha1:"),
            None if refers is None else int(refers), whole,
        ))
        self.number += 1
        self.start += len(data)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: rows of CHUNK_SCHEMA. The last row of a record has ``whole`` and no data.

    A record cut short fails the read. Nothing larger than a chunk is held, whatever a record's size.
    """
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]] for c in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()

        def out() -> pa.RecordBatch:
            columns = list(zip(*reader.rows, strict=True)) or [()] * len(names)
            reader.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        size = 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                reader.step(line)
                size += len(line)
                if size > 4 << 20:
                    yield out()
                    size = 0
        if reader.step != reader.begin:
            raise ValueError("an archive ends inside a record")
        yield out()

    lines = spark.read.schema("value string").option("lineSep", "\r\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, CHUNK_SCHEMA)


def record_summary(chunks: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact) per record, without payloads.

    A revisit has the size and digest of the response it refers to. ``intact``: the bytes read have the digest
    that the header declares.
    """
    last = chunks.where("whole").select(
        "page_id", "url", "record_type", "refers_to", "declared_digest", F.col("running_digest"), F.col("start").alias("payload_bytes")
    )
    last = materialize(last, "records")
    full = last.where("record_type = 'response' and page_id is not null").groupBy("page_id")
    full = full.agg(F.first("payload_bytes").alias("full_bytes"), F.first("running_digest").alias("full_digest"))
    wanted = last.where("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct()
    full = full.join(wanted, "page_id", "left_semi").withColumnRenamed("page_id", "refers_to")
    digest = F.coalesce("running_digest", "full_digest")
    return last.join(full, "refers_to", "left").select(
        "page_id",
        "url",
        F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        "refers_to",
        F.coalesce(digest == F.col("declared_digest"), F.lit(False)).alias("intact"),
    )
