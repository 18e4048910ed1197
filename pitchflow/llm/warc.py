"""WARC archives: write pages as captures, read archives back, assemble each capture's records.

A capture is a response (or a revisit of an equal payload), a request and a metadata record; the last
two name the first in WARC-Concurrent-To. Files are gzipped record by record in the shared folder. A
task's files count only if Spark commits the task's rows of the manifest, so repeated or
speculative attempts leave no record twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, bounded_batches, join_counted, new_path

FILE_BYTES = 64 << 20
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORDS = T.StructType([T.StructField(n, T.StringType()) for n in ("record_id", "type", "concurrent_to", "refers_to", "uri", "digest")] + [T.StructField("payload_bytes", T.LongType()), T.StructField("digest_ok", T.BooleanType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType())])

#: Tasks at most that read the archives, each file as a stream.
TASKS = 20_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, repr(parts))}>"


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 3, mtime=0)


def _one_line(x: str | None) -> str | None:
    return None if x is None else " ".join(x.split())


def capture(page_id, url: str | None, html: str | None, first_id, is_response: bool) -> bytes:
    """The three records of one page."""
    payload = (html or "").encode()
    digest, uri = base32_sha1(payload), _one_line(url)
    origin = _id("response", first_id, digest)
    me = origin if is_response else _id("revisit", page_id, url, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    date = ("WARC-Date", "1970-01-01T00:00:00Z")
    main = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", me), date, ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if not is_response:
        main += [("WARC-Refers-To", origin), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    rest = (uri or "").partition("://")[2]
    host, slash, path = rest.partition("/")
    asked = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    told = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("payload-length", len(payload))) if v is not None).encode()
    return b"".join([
        _record([("WARC-Type", "request"), ("WARC-Record-ID", _id("request", me)), date, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", me), ("Content-Type", "application/http; msgtype=request")], asked),
        _record(main, http + payload if is_response else http),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _id("metadata", me)), date, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", me), ("Content-Type", "application/warc-fields")], told),
    ])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> Table:
    """Writes three records a page under ``path`` (a new shared folder by default); the manifest lists the files."""
    spark = pages.sparkSession
    bounded_batches(spark, 256)
    base = path or new_path(spark, "warc")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    firsts = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    told = join_counted(rows, firsts, ["sha1"], "n").select("page_id", "url", "html", "first_id", F.col("page_id").eqNullSafe(F.col("first_id")).alias("is_response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(base)
        files.create_dir(root, recursive=True)
        name, out, size, count = None, None, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [count]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = capture(*row)
                out.write(data)
                size, count = size + len(data), count + 3
                if size >= FILE_BYTES:
                    yield from close()
                    out = None
        yield from close()

    manifest = told.mapInArrow(run, "file string, bytes long, records long")
    return Table(manifest.select(F.concat(F.lit(f"{base}/"), "file").alias("file"), "bytes", "records"), "warc-manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each."""
    part, held = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            held.append(part.decompress(data))
            data = part.unused_data if part.eof else b""
            if part.eof:
                yield b"".join(held)
                part, held = zlib.decompressobj(31), []


def parse_record(raw: bytes, with_payload: bool = True) -> dict:
    head, _, body = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode(errors="replace").split("\r\n")[1:] if ": " in x)
    block = body[: int(headers.get("Content-Length", 0))]
    kind = headers.get("WARC-Type")
    digest = headers.get("WARC-Payload-Digest", "").rpartition(":")[2] or None
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else b""
    lines = block.decode(errors="replace").split("\r\n") if kind in ("request", "metadata") else []
    return {
        "record_id": headers.get("WARC-Record-ID"), "type": kind, "concurrent_to": headers.get("WARC-Concurrent-To"), "refers_to": headers.get("WARC-Refers-To"), "uri": headers.get("WARC-Target-URI"), "digest": digest,
        "payload_bytes": len(payload) if kind == "response" else None, "digest_ok": base32_sha1(payload) == digest if kind == "response" else None,
        "fields": list((dict(x.split(": ", 1) for x in lines if ": " in x) | ({"request-line": lines[0]} if kind == "request" else {})).items()), "payload": payload if kind == "response" and with_payload else None,
    }


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in ``manifest(file)``, each file read as a stream by one task."""
    schema = pa.schema([*(pa.field(f.name, pa.string()) for f in RECORDS.fields[:6]), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                held, size = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for raw in _members(stream):
                        held.append(parse_record(raw, with_payload))
                        size += len(raw)
                        if len(held) >= 3000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = manifest.select("file").distinct()
    # A fixed number: files are short rows, and would be put together in one task; beyond TASKS, tasks read several.
    return files.repartition(max(1, min(TASKS, files.count()))).mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request, metadata and origin.

    A request or metadata record that names no capture is left out; a capture without one has a null
    there; if several of a kind name one capture, that with the lowest record id is taken. A revisit's
    payload size and page come from the response that it refers to, and are null if that is missing.
    """
    def side(kind: str, what: list[str]) -> DataFrame:
        rows = records.filter(F.col("type") == kind).filter("concurrent_to IS NOT NULL")
        return rows.groupBy("concurrent_to").agg(F.min_by(F.struct(*what), "record_id").alias(kind)).withColumnRenamed("concurrent_to", "record_id")

    captures = records.filter(F.col("type").isin("response", "revisit"))
    metadata = side("metadata", ["record_id", "fields"])
    origins = captures.filter("type = 'response'").join(metadata, "record_id", "left").groupBy("record_id")
    origins = origins.agg(F.min(F.element_at("metadata.fields", "page-id")).alias("page_id"), F.min("payload_bytes").alias("payload_bytes")).select(F.col("record_id").alias("refers_to"), F.struct("page_id", "payload_bytes").alias("origin"))
    # What a capture refers to may be the origin of a third of them; what refers to nothing isn't joined.
    refer = captures.filter("refers_to IS NOT NULL")
    origins = refer.groupBy("refers_to").agg(F.count("*").alias("n")).join(origins, "refers_to", "left")
    alone = captures.filter("refers_to IS NULL").withColumn("origin", F.lit(None).cast(origins.schema["origin"].dataType))
    told = join_counted(refer, origins, ["refers_to"], "n").unionByName(alone)
    whole = told.join(side("request", ["record_id", "uri", "fields"]), "record_id", "left").join(metadata, "record_id", "left")
    return whole.select("record_id", "type", "uri", "digest", "digest_ok", "payload_bytes", "payload", "request", "metadata", "origin")


def page_captures(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Writes the pages as archives, reads them back and returns one row per page.

    Columns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    * A null html is an empty payload; a null URL has no target URI; both may repeat.
    * Of pages with equal payloads that with the smallest page_id is the response. Rows that repeat that
      id are responses too. Null ids come last: they are revisits unless all ids of the payload are null.
    * A payload may have any length that a task can hold. Other columns than page_id, url and html aren't read.
    * The archives stay where they were written. An empty table gives an empty result.
    """
    return captures_of(write_archives(pages, id_col).df, pages.schema[id_col].dataType)


def captures_of(manifest: DataFrame, kind: T.DataType) -> DataFrame:
    """The rows of ``page_captures`` from the archives of ``manifest(file)``; a payload that isn't that of its digest is an error."""
    # Each page's own row of the archives, without payloads: their sizes and digests are taken on reading.
    records = Table(read_archives(manifest, with_payload=False), "warc-records")
    whole = assemble(records.df)
    damaged = F.raise_error(F.concat(F.lit("payload differs from its digest in "), "record_id")).cast("string")
    return whole.select(
        F.element_at("metadata.fields", "page-id").cast(kind).alias("page_id"),
        F.coalesce("payload_bytes", "origin.payload_bytes").alias("payload_bytes"),
        F.when(~F.col("digest_ok"), damaged).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", F.col("origin.page_id").cast(kind)).alias("refers_to"),
    )
