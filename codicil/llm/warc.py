"""WARC archives of pages, and the normaliser of whole-file gzip streams.

``write_archives`` writes one record for each page into archives that are a single gzip stream each, as some
crawlers leave them. ``normalise_archives`` inflates each such stream once, in bounded pieces, writes every record
as a gzip member of its own and a sidecar index of offsets beside it. ``read_archives`` reads single members by
that index. Records with equal payloads are written once; the others are revisits that refer to it.

A sidecar line is ``offset <tab> length <tab> type <tab> record id``.

Edge cases: a null page is an empty payload. Of equal payloads that with the smallest page_id is the response; a
null page_id counts as larger than any, and rows that repeat both page_id and payload are all responses where
theirs is the smallest. A null url leaves out the target; control characters in it are percent-encoded. An empty
table gives no archive and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.scratch import Scratch

#: Payloads under this many bytes are never revisits.
LEAST_BYTES = 0
#: Uncompressed bytes of an archive, and bytes inflated at once.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 18
#: Most shared digests that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: gzip levels of the one stream and of the members.
LEVEL_STREAM, LEVEL_MEMBER = 1, 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r?$", re.M)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has no block."""
    block = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, v in _HEADER.findall(head)}


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """Pieces of a gzip stream of one or more members, at most CHUNK bytes each."""
    d = zlib.decompressobj(31)
    data = source.read(CHUNK)
    while data:
        out = d.decompress(data, CHUNK)
        if out:
            yield out
        data = d.unconsumed_tail
        if d.eof:
            data, d = d.unused_data, zlib.decompressobj(31)
        if not data:
            data = source.read(CHUNK)
    rest = d.flush()
    if rest:
        yield rest


def normalise(source: BinaryIO, target: BinaryIO) -> Iterator[tuple[int, int, str, str]]:
    """Write every record of source as a gzip member of target; (offset, length, type, record id) of each."""
    pieces, held, offset = inflated(source), b"", 0
    while True:
        while b"\r\n\r\n" not in held:
            more = next(pieces, None)
            if more is None:
                if held:
                    raise ValueError("the stream ends inside a record's header")
                return
            held += more
        cut = held.index(b"\r\n\r\n") + 4
        head, held = held[:cut], held[cut:]
        own = headers(head)
        z = zlib.compressobj(LEVEL_MEMBER, zlib.DEFLATED, 31)
        length = target.write(part) if (part := z.compress(head)) else 0
        left = int(own["content-length"]) + 4
        while left:
            if not held:
                held = next(pieces)
            part, held = held[:left], held[left:]
            left -= len(part)
            if done := z.compress(part):
                length += target.write(done)
        length += target.write(z.flush())
        yield offset, length, own["warc-type"], own["warc-record-id"]
        offset += length


def _page(urn: str | None) -> int | None:
    value = (urn or "")[len("<urn:page:") : -1]
    return int(value) if value else None


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html and digest, refers_to, revisit of each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    shared = own.where(F.octet_length("html") >= LEAST_BYTES).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first")
    few = shared.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    joined = own.join(F.broadcast(shared) if few else shared, "sha1", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write the records as whole-file gzip archives below folder; (path, records) of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        out = z = path = None
        size = n = 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            out.write(z.flush())
            out.close()
            done.append((path, n))

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                if out is None:
                    path = f"{root}/{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, z, size, n = store.open_output_stream(path, compression=None), zlib.compressobj(LEVEL_STREAM, zlib.DEFLATED, 31), 0, 0
                data = record(page_id, url, payload, sha1(payload), refers_to, revisit)
                out.write(z.compress(data))
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return decided.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, "path string, records long")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive (path) into folder; (path, index, records) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(name, compression=None) as target:
                    lines = ["\t".join(map(str, x)) for x in normalise(source, target)]
                with store.open_output_stream(name + ".idx") as f:
                    f.write("".join(f"{x}\n" for x in lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([name + ".idx"]), pa.array([len(lines)], pa.int64())], names=["path", "index", "records"])

    n = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("path").repartition(max(n, archives.rdd.getNumPartitions()), "path").mapInArrow(run, "path string, index string, records long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(normal: DataFrame, folder: str) -> DataFrame:
    """READ of each record of the normalised archives (path, index), member by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(index) as f:
                    lines = f.read().decode().splitlines()
                rows = []
                with store.open_input_file(path) as f:
                    for line in lines:
                        offset, length, kind, _ = line.split("\t")
                        f.seek(int(offset))
                        data = zlib.decompress(f.read(int(length)), 31)
                        head, _, rest = data.partition(b"\r\n\r\n")
                        own = headers(head)
                        digest, size = own["warc-payload-digest"].removeprefix("sha1:"), int(own["x-payload-length"])
                        if kind == "response":
                            payload = rest[: int(own["content-length"])]
                            size, seen = len(payload), sha1(payload)
                            if seen != digest:
                                raise ValueError(f"{path} at {offset}: the payload's digest is {seen}, not {digest}")
                        rows.append((_page(own["warc-record-id"]), size, digest, own["warc-type"], _page(own.get("warc-refers-to"))))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return normal.select("path", "index").repartition(max(2, normal.rdd.getNumPartitions()), "path").mapInArrow(run, READ)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write pages as archives in a working folder, normalise them and return what is read back."""
    with Scratch(pages.sparkSession, "warc") as scratch:
        whole = scratch.save(write_archives(decide(pages), scratch.path("whole")), "whole-list")
        normal = scratch.save(normalise_archives(whole, scratch.path("normal")), "normal-list")
        scratch.drop("whole")
        return scratch.result(read_archives(normal, scratch.path("normal")))
