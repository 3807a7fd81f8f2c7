"""WARC archives from pages, and back as a table of chunks.

``write`` puts one record per page into gzip archives (one member a record) in the shared folder.  Of pages with equal payloads of
``LEAST_REVISIT`` bytes or more, the one with the largest page_id is the response and the others are
revisits that refer to it and repeat its digest and length without its bytes.  Which is which comes from digests alone:
they are aggregated before the shuffle, and only the revisits' ids return to the pages.  A task names its archives after
itself and a random number and returns a manifest row for each; the manifest is what is read, so archives of lost
or repeated attempts don't count.

``read`` streams the archives: a payload comes out as rows (record, chunk number, bytes) of at most
``CHUNK`` bytes, each with the bytes and the SHA-1 of the payload up to its end, so that neither reader nor table holds a whole
record.  A record's last chunk is marked; an empty payload and a revisit have one empty chunk.

Archives are opened with pyarrow's file systems, so the shared folder must be of a kind they know (local or mounted, S3, GCS, HDFS).

Null html is an empty payload.  A null url has no target header.  A null page_id is written and read back as null, never refers and is never referred to.
Rows that repeat the largest page_id of equal payloads are all responses.  Extra columns are ignored.  An empty table gives
no archives and an empty table.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch_path, short_batches, stage

LEAST_REVISIT, CHUNK, ARCHIVE, LEVEL = 1000, 1 << 18, 64 << 20, 1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
CHUNKS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()),
    ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
CHUNKS_DDL = ("page_id long, url string, record_type string, refers_to long, chunk_no long, chunk binary, bytes_so_far long, sha1_so_far string, last boolean, "
              "payload_bytes long, payload_digest string")


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1) and refers_to (null for responses) of every page."""
    own = short_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = own.where(F.octet_length("payload") >= least).select("page_id", "digest")
    same = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = large.join(same, "digest").where("page_id < refers_to").distinct()
    return own.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    tail = (urn or "null>")[:-1].rpartition(":")[2]
    return None if tail == "null" else int(tail)


def _record(page_id: int | None, url: str | None, payload: memoryview, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """The record's bytes in pieces."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if refers_to is None else payload[:0]
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    for i in range(0, len(body), CHUNK):
        yield body[i:i + CHUNK]
    yield b"\r\n\r\n"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        stem = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, done, records, size = None, [], 0, 0
        for piece in cut(batches, "payload"):
            rows = zip(*(piece.column(c).to_pylist() for c in ("page_id", "url")), piece.column("payload"), *(piece.column(c).to_pylist() for c in ("digest", "refers_to")))
            for page_id, url, payload, digest, refers_to in rows:
                if out is None:
                    path, records, size = f"{root}/{stem}-{len(done):05d}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                for part in _record(page_id, url, memoryview(payload.as_buffer()), digest, refers_to):
                    size += out.write(member.compress(part))
                size += out.write(member.flush())
                records += 1
                if size >= ARCHIVE:
                    out.close()
                    out = None
                    done.append((path, records, size))
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])
    return run


def write(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes the archives; returns their manifest (path, records, bytes) and the folder."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return stage(decide(pages).mapInArrow(_write(folder), MANIFEST), "manifest"), folder


def _header(stream: io.BufferedReader) -> dict[str, str] | None:
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/1."):
        raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
    fields: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        fields[name.lower()] = value
    return fields


def chunks_of(stream: io.BufferedReader, chunk: int = CHUNK) -> Iterator[tuple]:
    """The chunk rows of all records of an archive, one chunk in memory at a time."""
    while (fields := _header(stream)) is not None:
        left, length = int(fields["content-length"]), 0
        while left:
            line = stream.readline(left)
            left -= len(line)
            name, _, value = line.decode("latin-1").partition(":")
            if name.lower() == "content-length":
                length = int(value)
            if line in (b"\r\n", b""):
                break
        declared = base64.b32decode(fields["warc-payload-digest"].rpartition(":")[2]).hex()
        url = fields.get("warc-target-uri")
        url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        refers = _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
        digest, so_far, no = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if left and not data:
                raise ValueError("the archive ends within a record")
            left -= len(data)
            so_far += len(data)
            digest.update(data)
            if not left and refers is None and (digest.hexdigest() != declared or so_far != length):
                raise ValueError(f"the payload of {fields.get('warc-record-id')} isn't what its header says")
            yield (_page(fields["warc-record-id"]), url, fields["warc-type"], refers, no, data, so_far, digest.hexdigest(), not left, length, declared)
            no += 1
            if not left:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its header says")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for row in chunks_of(io.BufferedReader(plain, 1 << 20)):
                        rows.append(row)
                        size += len(row[5]) + 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)
    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The chunk table of the manifest's archives."""
    return manifest.repartition(max(1, min(manifest.count(), 20_000))).mapInArrow(_read(folder), CHUNKS_DDL)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: what its last chunk says of the whole payload."""
    whole = F.col("record_type") == "response"
    return chunks.where("last").select(
        "page_id", F.when(whole, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("sha1_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
