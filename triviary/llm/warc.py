"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Reader: the files are cut into byte ranges. A task looks for gzip magic in its range, takes a place for a member's start
only if what it decodes there is a WARC header, the member's checksum holds and the next member (or the file's end) follows
it, and owns the records that start inside its range, reading past the range's end to finish the last one.

Writer: of records with equal payloads of at least `least` bytes, the one with the smallest key is written as a response and
the others as revisits that name it; a group's rows are spread by salt, so one payload may make up any share of the rows.

Nulls: a null payload is an empty one; a null url is left out; a null key never comes first if another is there, and rows that
share the smallest key are all responses. An empty table gives no archive and no record. Control characters and spaces in urls
are percent-encoded. A record is held in memory by one task; nothing else is.

Files go through pyarrow's file systems, so the folder can be any that driver and executors share (a mount, S3, GCS, HDFS with
libhdfs). File names hold the task attempt, and the table of files lists those of finished tasks only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, slices

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else uri)


def urn(key: int | None) -> str:
    return f"<urn:x-page:{'none' if key is None else key}>"


def of_urn(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC 1.1 record, response or revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    block = head + payload if refers_to is None else head
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_originals(df: DataFrame, key: str, payload: str, least: int = 0, salts: int = 32) -> DataFrame:
    """df with `refers_to`: null for responses, the smallest key of the equal payloads for revisits."""
    df = df.withColumn("_sha", F.when(F.length(payload) >= least, F.unhex(F.sha1(payload)))).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    firsts = df.where("_sha is not null").groupBy("_sha").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    firsts = firsts.select("_sha", "_first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    joined = df.join(firsts.hint("shuffle_hash"), ["_sha", "_salt"], "left")
    return joined.withColumn("refers_to", F.when(F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first")), F.col("_first"))).drop("_sha", "_salt", "_first")


def write(df: DataFrame, folder: str, key: str, url: str, html: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", roll: int = 1 << 30, level: int = 5) -> str:
    """Writes a record per row to .warc.gz files in `folder`; returns the path of the table of files (path, bytes, records)."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = with_originals(rows, "key", "payload", least).select("key", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        task, out, path, size, n = TaskContext.get(), None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": n}], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for b in slices(batches, 2):
            for k, u, p, r in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    path, size, n, out = f"{folder}/{name}", 0, 0, fs.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(k, u, p, r, date), level, mtime=0)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    files = f"{folder}/files"
    rows.mapInArrow(run, FILES).write.parquet(files)
    return files


class Bytes:
    """A file's bytes by position, read ahead in blocks."""

    def __init__(self, f, size: int, block: int = 1 << 20):
        self.f, self.size, self.block, self.at, self.buf = f, size, block, 0, b""

    def get(self, pos: int) -> memoryview:
        """What is at hand from pos on; empty only at the end."""
        if not self.at <= pos < self.at + len(self.buf):
            self.f.seek(pos)
            self.at, self.buf = pos, self.f.read(self.block)
        return memoryview(self.buf)[pos - self.at :]

    def exactly(self, pos: int, n: int) -> bytes:
        out = b""
        while len(out) < n and (got := bytes(self.get(pos + len(out))[: n - len(out)])):
            out += got
        return out

    def find(self, pos: int, end: int) -> int:
        """The first gzip magic that starts in [pos, end), or -1."""
        while pos < end:
            got = bytes(self.get(pos))
            if len(got) < 3 and not (got := self.exactly(pos, 3))[2:]:
                return -1
            at = got.find(MAGIC)
            if at >= 0:
                return pos + at if pos + at < end else -1
            pos += len(got) - 2
        return -1


def member(data: Bytes, pos: int) -> tuple[bytes, int] | None:
    """The record of the gzip member at pos and where the member ends; None if none starts there."""
    z, out, at = zlib.decompressobj(31), [], pos
    try:
        while not z.eof:
            got = data.get(at)
            if not len(got):
                return None
            out.append(z.decompress(got))
            at += len(got)
            if sum(map(len, out[:8])) >= 5 and not b"".join(out[:8]).startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    end = at - len(z.unused_data)
    text = b"".join(out)
    return (text, end) if text.startswith(b"WARC/") and data.exactly(end, 3) in (b"", MAGIC) else None


def headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parsed(text: bytes, with_payload: bool) -> dict:
    head, _, rest = text.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[: int(h.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    out = {"key": of_urn(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": h.get("warc-type"), "refers_to": of_urn(h.get("warc-refers-to")), "payload": None}
    if out["record_type"] == "revisit":
        out |= {"payload_bytes": int(headers(http)["content-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:")}
    else:
        out |= {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload if with_payload else None}
        if (said := h.get("warc-payload-digest")) and said != f"sha1:{out['payload_digest']}":
            raise ValueError(f"the payload of {h.get('warc-record-id')} doesn't match its digest")
    return out


def records(data: Bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The records whose members start in [start, end)."""
    pos = start
    while (pos := data.find(pos, end)) >= 0:
        found = member(data, pos)
        if found is None:
            pos += 1
            continue
        yield pos, found[0]
        pos = found[1]


def read(spark: SparkSession, files: DataFrame, split: int = 32 << 20, with_payload: bool = True) -> DataFrame:
    """The records of the archives in `files` (path, bytes), by byte ranges of `split` bytes."""
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    names = [f.name for f in RECORDS]
    schema = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RECORDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    rows, held = [], 0
                    for offset, text in records(Bytes(f, size), start, min(size, start + split)):
                        rows.append(parsed(text, with_payload) | {"path": path, "offset": offset})
                        held += len(text) if with_payload else 300
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.repartition(max(1, min(int(n), 20_000))).mapInArrow(run, RECORDS).select(*names)


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, split: int = 8 << 20) -> DataFrame:
    """Writes df to new archives in the shared folder and returns what reading them gives."""
    spark = df.sparkSession
    files = write(df, new_path(spark, "warc"), key, url, html, least)
    return read(spark, spark.read.schema(FILES).parquet(files), split, with_payload=False)
