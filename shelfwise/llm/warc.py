"""WARC archives: writer with revisit records, splittable reader (operator 1).

Every record is a gzip member of its own. The reader cuts archives into byte ranges; a task scans its range for the gzip magic,
accepts a candidate member only if it decodes to a WARC header, and owns the records that start inside its range, reading past
the end for the last one. Members that follow a record directly are taken without scanning. Archive bytes are read and written in
tasks with `pyarrow.fs`, which takes local, HDFS, S3 and GCS addresses; the driver handles names and sizes only.

Each writing task names its archives anew and reports them in a manifest; an attempt that was lost leaves files which the
manifest does not list and nobody reads.

Defined cases: a null html is an empty payload; a null url leaves the target header out; control characters in a url are
percent-encoded; pages without an id are responses and come back with a null id; rows that share the largest page_id of a
group of equal payloads are all responses; an empty table gives an empty archive list; further columns are not archived.
A payload which itself holds a whole WARC member, stored uncompressed by gzip, can be taken for a record if a range starts inside it.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import new_path, stage
from shelfwise.llm.text import whole

MAGIC = b"\x1f\x8b\x08"
REVISIT_FROM = 1000
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
YIELD_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("page_id bigint, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to bigint, "
           "intact boolean, payload binary")
MANIFEST = "path string, bytes bigint, records bigint"


def _address(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(address: str | None) -> int | None:
    number = (address or "")[len("<urn:page:"):-1]
    return int(number) if number else None


def _digest_text(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _digest_hex(text: str | None) -> str | None:
    return base64.b32decode(text.removeprefix("sha1:")).hex() if text else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed record. A revisit keeps the HTTP header, with the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_address(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: {_digest_text(digest)}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_address(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        out, path, size, count = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    system.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, size, count = system.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, 0
                data = record(page_id, url, html.encode("utf-8"), digest, refers_to)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return write


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with payload digest and, where an equal payload of some size is archived for a larger page_id, that page.

    Only digests with two pages or more are joined; large groups are split by adaptive execution, the digest side being one row.
    """
    read = pages.select("page_id", "url", whole("html").alias("html")).withColumn("digest", F.sha1("html"))
    large = read.filter(F.octet_length("html") >= REVISIT_FROM).groupBy(F.col("digest").alias("_digest"))
    shared = large.agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    refers = F.when(F.col("page_id") < F.col("_last"), F.col("_last"))
    return read.join(shared, read["digest"] == shared["_digest"], "left").select(
        "page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per page below `folder`; the manifest of the archives written."""
    return stage(with_revisits(pages).mapInArrow(_writer(folder, archive_bytes), MANIFEST), "warc-manifest")


class _Window:
    """Bytes of an archive from a start on, fetched piece by piece and forgotten as they are used."""

    def __init__(self, source, at: int, size: int):
        self.source, self.at, self.size, self.bytes = source, at, size, b""

    def fill(self, amount: int) -> bool:
        while len(self.bytes) < amount and self.at + len(self.bytes) < self.size:
            self.source.seek(self.at + len(self.bytes))
            piece = self.source.read(READ_BYTES)
            if not piece:
                break
            self.bytes += piece
        return len(self.bytes) >= amount

    def skip(self, amount: int) -> None:
        self.bytes, self.at = self.bytes[amount:], self.at + amount


def _is_record(data: bytes) -> bool:
    """Whether a gzip member that starts here decodes to a WARC version line."""
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(window: _Window) -> bytes | None:
    """Decode the member at the window's start and move behind it; None if it is damaged."""
    packer, parts, used = zlib.decompressobj(31), [], 0
    while not packer.eof:
        if not window.fill(used + 1):
            return None
        piece = window.bytes[used:]
        try:
            parts.append(packer.decompress(piece))
        except zlib.error:
            return None
        used += len(piece) - len(packer.unused_data)
        if not packer.eof:
            window.skip(used)
            used = 0
    window.skip(used)
    return b"".join(parts)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def parse(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {name.strip().lower(): value.strip() for name, _, value in pairs}
    return Record(headers, rest[: int(headers.get("content-length", 0))])


def records_in(source, start: int, end: int, size: int) -> Iterator[Record]:
    """Records whose member starts in [start, end)."""
    window = _Window(source, start, size)
    while window.at < end:
        window.fill(64 << 10)
        found = window.bytes.find(MAGIC)
        if found < 0:
            if not window.bytes:
                return
            # the last two bytes may begin a magic
            window.skip(max(len(window.bytes) - len(MAGIC) + 1, 1))
            continue
        window.skip(found)
        if window.at >= end:
            return
        window.fill(64 << 10)
        if not _is_record(window.bytes):
            window.skip(1)
            continue
        begin, held = window.at, window.bytes
        data = _member(window)
        if data is None:
            # damaged member: go on scanning behind its magic
            window.at, window.bytes = begin, held
            window.skip(1)
            continue
        yield parse(data)


def _row(rec: Record, with_payload: bool) -> tuple:
    http, _, payload = rec.block.partition(b"\r\n\r\n")
    kind, stated = rec.headers.get("warc-type"), _digest_hex(rec.headers.get("warc-payload-digest"))
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    if kind == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    else:
        digest, size, payload = stated, int(length[1]) if length else 0, None
    return (_page_of(rec.headers.get("warc-record-id")), kind, rec.headers.get("warc-target-uri"), size, digest,
            _page_of(rec.headers.get("warc-refers-to")), digest == stated, payload if with_payload else None)


def _reader(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ranges in batches:
            for path, start, end, size in zip(*[c.to_pylist() for c in ranges.columns]):
                system, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_file(name) as source:
                    for rec in records_in(source, start, end, size):
                        rows.append(_row(rec, with_payload))
                        held += len(rec.block) if with_payload else 200
                        if held >= YIELD_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return read


def read_archives(manifest: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives listed as (path, bytes). Revisits have no payload; `intact` says whether the digest agrees."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    ranges = manifest.filter("bytes > 0").select("path", "bytes", starts.alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + range_bytes).alias("end"), "bytes")
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(int(total)).mapInArrow(_reader(with_payload), RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "intact")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS dig, strlen(html)::BIGINT AS n FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY dig) END AS last FROM d)
SELECT page_id, n AS payload_bytes, dig AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to, url AS target_uri, true AS intact FROM m"""
