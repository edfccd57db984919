"""Operator 7, WARC archives compressed with an embedded Zstandard dictionary.

An archive file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary; after it
each record is one frame of its own compressed with that dictionary, so a reader needs nothing but the file
and can start at any frame. The dictionary is built on the driver from records as they are archived, headers included: at most
``sample_rows`` of them (in order of a digest of their ids), each cut to ``sample_bytes`` for this purpose only. A response holds an HTTP
message, a revisit names the response's record.

Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is a response; the
others are revisits that name it. Rows that share that page_id as well are all responses. Smaller payloads are
always responses. Digests are grouped with partial aggregation, and the join that carries decisions back is one
that adaptive execution can split, so a payload shared by a third of all pages stays spread out.

Files go to the shared folder by pyarrow's file systems (any scheme it knows), each written under a temporary
name and renamed when complete, under a name that depends on the partition only: a task that runs again
replaces its own file. Null html is an empty payload; null url an empty target; null page_id is kept as null
and may only be a revisit's target if no other id shares its payload. Empty table: no archives, no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import in_batches, slices
from .common import scratch

MAGIC = 0x184D2A5D
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: A file is closed and the next one begun when it has grown to this size.
FILE_BYTES = 256 << 20


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def decided(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, record_type, refers_to) for each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    large = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("b")).filter(F.octet_length("b") >= least)
    shared = large.groupBy(F.sha1("b").alias("sha1"), F.octet_length("b").cast("long").alias("payload_bytes")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    out = rows.join(shared, ["sha1", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "payload_bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


#: What stands before each payload in a response: records hold HTTP messages.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{'' if page_id is None else page_id} {sha1}')}>"


def record(kind: str, page_id: int | None, url: str | None, sha1: str, n: int, refers_to: int | None, payload: bytes) -> bytes:
    """A whole record. A revisit holds no payload but names the response by its record id."""
    body = HTTP + payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, sha1)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {n}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        lines[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(pages: DataFrame, sample_rows: int = 2000, sample_bytes: int = 8192, size: int = 64 << 10) -> bytes:
    """Trained on the records of a bounded sample, each cut to sample_bytes; empty if the sample is too small to train on."""
    html = F.substring(F.coalesce(F.col("html").cast("string"), F.lit("")), 1, sample_bytes)
    ids = pages.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_rows)
    sample = pages.join(F.broadcast(ids.distinct()), "page_id", "left_semi").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).orderBy("page_id", "html")
    parts = [record("response", r["page_id"], r["url"], hashlib.sha1(r["html"].encode()).hexdigest(), len(r["html"]), None, r["html"].encode())[:sample_bytes] for r in sample.limit(sample_rows).toLocalIterator() if r["html"]]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes() if len(parts) >= 8 else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    """One archive after another in a folder, as prefix-00000.warc.zst and so on."""

    def __init__(self, folder: str, prefix: str, words: bytes, level: int = 3):
        self.fs, self.folder = file_system(folder)
        self.prefix, self.words, self.n, self.out, self.size = prefix, words, 0, None, 0
        data = zstandard.ZstdCompressionDict(words) if words else None
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.folder}/{self.prefix}-{self.n:05d}.warc.zst"
            self.temporary = f"{self.folder}/.{self.prefix}-{self.n:05d}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.out.write(struct.pack("<II", MAGIC, len(self.words)) + self.words)
            self.size = 8 + len(self.words)
        frame = self.zstd.compress(record)
        self.out.write(frame)
        self.size += len(frame)
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> str | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temporary, self.name)
        self.out, self.n = None, self.n + 1
        return self.name


def write(pages: DataFrame, folder: str, least: int = 1000, **how: int) -> list[str]:
    """Writes the archives and returns their paths, one per partition unless that grows past FILE_BYTES."""
    spark = pages.sparkSession
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    words = spark.sparkContext.broadcast(dictionary(pages, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, names = Writer(folder, f"part-{TaskContext.get().partitionId():05d}", words.value), []
        for b in slices(batches, "payload"):
            for page, url, payload, n, sha1, kind, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "sha1", "record_type", "refers_to")), strict=True):
                before = writer.n
                writer.add(record(kind, page, url, sha1, n, refers, payload))
                if writer.n > before:
                    names.append(writer.name)
        if last := writer.close():
            names.append(last)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    return sorted(r["path"] for r in in_batches(decided(pages, least), run, "path string").collect())


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of an archive, frame by frame in bounded reads."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    words = stream.read(n)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    rest, data, parts = b"", zstd.decompressobj(), []
    while chunk := rest or stream.read(1 << 20):
        parts.append(data.decompress(chunk))
        rest = b""
        if data.eof:
            raw = b"".join(parts)
            head, _, body = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, body[: int(fields["Content-Length"])]
            rest, data, parts = data.unused_data, zstd.decompressobj(), []
    if parts and any(parts):
        raise ValueError("the archive ends within a record")


def read(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """The records of the archives, payloads of responses checked against their digests."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for h, body in records(stream):
                        body = body.removeprefix(HTTP)
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if h["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload of {h['X-Page-Id']} doesn't match its digest")
                        rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, h["WARC-Type"], int(h["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in h else None, body if h["WARC-Type"] == "response" else None))
                        held += len(body)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return in_batches(files, run, SCHEMA)


def archived(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes pages to archives in the shared folder and reads those back, payloads left out."""
    folder = scratch(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, folder, least), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
