"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of a few hundred kilobytes of whole records, and ends with the seek table
of the seekable format: a skippable frame that lists the sizes of the frames. A record is found by its bundle, frame and place in
the frame, so reading one decompresses one frame. `zstd -d` reads a bundle as one WARC file, as skippable frames are skipped.

Records of equal payload are written once: the one with the smallest id is a response, others are revisits that refer to it. Payloads
meet their digest's first id in one sort-merge join, which Spark splits where a payload is very common.

Bundles are written by the tasks to the shared folder under names of their own (partition and a random part); only those of tasks that
succeeded are in the index, so a lost executor or a task run twice leaves no wrong record. Reading goes by the index.

Rows: a null html is an empty payload. A null url is an empty target. Rows equal in id and payload give equal records, each a
response if its id is the smallest. Null ids never are the smallest; if all ids of a payload are null, all are responses. A very long
page is a frame of its own. Empty table: no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_INDEX = "path string, record_id string, frame int, offset long, length long"
_INDEX_ARROW = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])


def filesystem(uri: str):
    """(file system, path) of a folder as Hadoop names it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, payload_digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMES, f'{page}:{payload_digest}')}"


def record(page: int | None, url: str | None, payload: bytes, first: int | None, date: str = "2024-01-01T00:00:00Z") -> tuple[str, bytes]:
    """(record id, bytes) of a response (first is None) or of a revisit of the page `first`."""
    d = digest(payload)
    name = record_id(page, d)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{d}"),
    ]
    if first is not None:
        fields += [("WARC-Refers-To", f"<{record_id(first, d)}>"), ("WARC-Profile", REVISIT), ("X-Refers-To-Page", str(first))]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    fields += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return name, head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Bundle:
    """Writes records into frames and at the end the seek table."""

    def __init__(self, folder: str, name: str, frame_bytes: int, level: int):
        import zstandard

        fs, path = filesystem(folder)
        self.path, self.out = f"{folder}/{name}", fs.open_output_stream(f"{path}/{name}", compression=None)
        self.zstd, self.most = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.held, self.size, self.index = [], 0, []
        self.written = 0

    def add(self, name: str, raw: bytes) -> None:
        if self.size and self.size + len(raw) > self.most:
            self._frame()
        self.index.append((self.path, name, len(self.frames), self.size, len(raw)))
        self.held.append(raw)
        self.size += len(raw)

    def _frame(self) -> None:
        data = self.zstd.compress(b"".join(self.held))
        self.out.write(data)
        self.frames.append((len(data), self.size))
        self.written += len(data)
        self.held, self.size = [], 0

    def close(self) -> list[tuple]:
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.frames)
        footer = table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(footer)) + footer)
        self.out.close()
        return self.index


class Reader:
    """Frames of one bundle, by its seek table."""

    def __init__(self, path: str):
        import zstandard

        fs, at = filesystem(path)
        self.file, self.zstd = fs.open_input_file(at), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        raw = self.file.read_at(n * width, size - 9 - n * width)
        self.frames, place = [], 0
        for k in range(n):
            c, d = struct.unpack_from("<II", raw, k * width)
            self.frames.append((place, c, d))
            place += c
        self.now, self.data = -1, b""

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.now:
            place, c, d = self.frames[frame]
            self.now, self.data = frame, self.zstd.decompress(self.file.read_at(c, place), max_output_size=d)
        return self.data[offset : offset + length]


def _write(batches: Iterator[pa.RecordBatch], folder: str, frame_bytes: int, bundle_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    bundle, n = None, 0
    part = TaskContext.get().partitionId()

    def done() -> pa.RecordBatch:
        rows = bundle.close()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_ARROW.types)], schema=_INDEX_ARROW)

    for b in batches:
        for page, url, html, first in zip(*(b.column(c) for c in ("page", "url", "html", "first"))):
            if bundle is None:
                bundle = Bundle(folder, f"{part:05d}-{n:04d}-{uuid.uuid4().hex}.warc.zst", frame_bytes, level)
                n += 1
            page, first = page.as_py(), first.as_py()
            again = first is not None and first != page
            bundle.add(*record(page, url.as_py(), html.as_buffer().to_pybytes() if html.is_valid else b"", first if again else None))
            if bundle.written > bundle_bytes:
                yield done()
                bundle = None
    if bundle is not None:
        yield done()


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes the archives and returns their index: path, record_id, frame, offset and length in the frame.

    folder: where bundles go; by default a new folder below the shared one. min_bytes: payloads shorter than this are never revisits.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.cast("binary").alias("html"))
    rows = rows.withColumn("d", F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256)))
    firsts = ws.table(rows.where("d is not null").groupBy("d").agg(F.min("page").alias("first"), F.count("*").alias("c")).where("c > 1").select("d", "first"), "firsts")
    joined = rows.join(firsts, "d", "left").select("page", "url", "html", "first")
    at = qualified(spark, folder or f"{ws.path}/bundles")
    fs = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(fs)
    return ws.table(joined.mapInArrow(lambda b: _write(b, at, frame_bytes, bundle_bytes, level), _INDEX), "index")


_READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch], verify: bool) -> Iterator[pa.RecordBatch]:
    reader, path = None, None
    for b in batches:
        rows = []
        for p, frame, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "frame", "offset", "length"))):
            if p != path:
                reader, path = Reader(p), p
            fields, payload = parse(reader.read(frame, offset, length))
            d = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            response = fields["WARC-Type"] == "response"
            if response and verify and digest(payload) != d:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
            whole = len(payload) if response else int(fields["X-Payload-Length"])
            page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
            rows.append((int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"], int(to) if to else None, d, whole, payload if response else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_ARROW.types)], schema=_READ_ARROW)


def read(index: DataFrame, frames_a_task: int = 64, verify: bool = True) -> DataFrame:
    """The records that the index lists, from the archives. Any part of an index reads just its records. Payloads of responses are
    checked against their digests; a revisit's payload is null, its length and digest are those of what it refers to."""
    groups = index.withColumn("g", F.floor(F.col("frame") / frames_a_task))
    n = groups.select("path", "g").distinct().count()  # the index is small for what it makes tasks read, so Spark would merge them
    dealt = groups.repartition(max(1, n), "path", "g").sortWithinPartitions("path", "frame", "offset")
    return dealt.select("path", "frame", "offset", "length").mapInArrow(lambda b: _read(b, verify), _READ)
