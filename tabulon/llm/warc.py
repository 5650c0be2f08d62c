"""WARC archives: a writer, and a sequential reader with bounded memory.

Writing: each page becomes a record, each record a gzip member of its own. Of pages with equal
payloads of at least ``SMALL`` bytes, the one with the smallest page_id becomes a ``response`` record
and the others ``revisit`` records that refer to it. Which they are is found from ids, digests and
sizes alone; payloads move once, by page_id and digest, so copies of a page do not meet in a task, and
those of revisits are not written. Tasks write archives of about ``ARCHIVE_BYTES``
into the shared folder, under names that no other attempt uses, and return them in a manifest; only
what the manifest lists is read, so a task that is run again leaves nothing wrong behind.

Reading: each archive is read front to back in chunks; one ``zlib`` object per member decompresses
incrementally; Content-Length frames the block; block and payload digests are verified. Memory is
bounded by the longest record. A damaged archive raises ``ValueError`` with its name and offset.

Defined cases: a null html is an empty payload; a null url gives a record without target URI, and
control characters in a url are percent-encoded; a payload of any length is one record, whole; rows with one page_id and equal payloads, where it
is the smallest, are all responses; a null page_id comes after all others; other columns are not
written; an empty table gives no archives and no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.session import arrow, cut, partitions, shared_path, table

SMALL, ARCHIVE_BYTES, CHUNK, LEVEL = 100, 256 << 20, 1 << 16, 6
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL, END = b"\r\n", b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """The bytes of one record, not yet compressed. A revisit has ``refers_to`` and no payload."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    def page(self, header: str) -> int | None:
        found = re.search(r"<urn:page:(-?\d+)>", self.headers.get(header, ""))
        return int(found[1]) if found else None


def _headers(lines: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])


def _parse(data: bytes, where: str) -> Record:
    head, found, rest = data.partition(END)
    if not found or not head.startswith(b"WARC/"):
        raise ValueError(f"{where}: no WARC header")
    headers = _headers(head)
    size = int(headers["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != END:
        raise ValueError(f"{where}: the record is not framed by its Content-Length")
    if headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"{where}: the block digest differs")
    http, _, payload = block.partition(END)
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError(f"{where}: the payload digest differs")
    return Record(headers, _headers(http), payload)


def read_records(stream: BinaryIO, name: str = "archive", chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive, one after the other."""
    rest, offset = b"", 0
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if used:
                    raise ValueError(f"{name} at {offset}: the last record is cut short")
                return
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise ValueError(f"{name} at {offset}: {e}") from e
            used += len(data) - len(z.unused_data)
            rest = z.unused_data
        yield _parse(b"".join(parts), f"{name} at {offset}")
        offset += used


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", uri))


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null for revisits), digest, size and refers_to (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    digest, size = F.unhex(F.sha2(html, 256)).alias("digest"), F.octet_length(html).cast("long").alias("size")
    key = [F.coalesce("page_id", F.lit(0)).alias("key"), F.col("page_id").isNull().alias("nameless")]
    slim = pages.select("page_id", *key, digest, size).filter(F.col("size") >= SMALL)
    # a written table, so that the optimiser can split the task of a frequent digest
    first = cut(slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 AND first IS NOT NULL").drop("copies"))
    revisits = slim.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("key", "nameless", "digest", F.col("first").alias("refers_to")).distinct()
    rows = pages.select("page_id", *key, "url", html.alias("html"), digest, size).join(revisits, ["key", "nameless", "digest"], "left")
    own = F.when(F.col("refers_to").isNull(), F.col("html")).alias("html")
    return rows.select("page_id", "url", own, F.lower(F.hex("digest")).alias("digest"), "size", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their manifest: path, records, bytes. The manifest is a
    written table: reading it again does not write again."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        task, done, out = TaskContext.get(), [], None
        for batch in batches:
            for page_id, url, html, digest, size, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "refers_to"))):
                if out is None:
                    done.append([f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz", 0, 0])
                    out = files.open_output_stream(f"{path}/{done[-1][0]}", compression=None)
                data = member(record(page_id, url, b"" if refers_to is not None else html.encode(), digest, size, refers_to))
                out.write(data)
                done[-1][1] += 1
                done[-1][2] += len(data)
                if done[-1][2] >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        names, records, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return cut(arrow(plan_records(pages), scan, "path string, records bigint, bytes bigint"))


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, payload: bool = True, rows: int = 256) -> DataFrame:
    """One row per record of the listed archives; without ``payload``, that column is null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                files, path = _open(uri)
                out = []
                with files.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, uri):
                        out.append((r.page("WARC-Record-ID"), int(r.http["Content-Length"]), r.headers["WARC-Payload-Digest"].removeprefix("sha256:"), r.headers["WARC-Type"], r.page("WARC-Refers-To"), r.headers.get("WARC-Target-URI"), r.payload if payload else None))
                        if len(out) == rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SCHEMA.types)], schema=SCHEMA)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SCHEMA.types)], schema=SCHEMA)

    spread = manifest.select("path").repartition(partitions(manifest.sparkSession), "path")
    return arrow(spread, scan, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read_archives(manifest, payload=False).drop("url", "payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
