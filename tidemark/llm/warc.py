"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with the
seek table of the public seekable format (a skippable frame that lists the
compressed and decompressed size of every frame), so any Zstandard reader can
read the bundle through, and a reader with an offset can decode one frame. The
index maps a record's id to (bundle, frame, offset in the frame, length).

Payload digests come from Spark's SHA-1. The smallest page id of each digest is
found by a grouped minimum, which pre-aggregates copies before the shuffle; the
join that returns it leaves Spark free to split a digest that many pages share.

Bundles are written whole by the task that made them, under a name of their own
for each attempt; only bundles in the index, which Spark commits, are read, so
repeated or lost attempts leave nothing that counts.

A null payload is empty. Rows equal in payload whose page id is the smallest are
all responses (ties); rows without an id are revisits of it, or responses where
no copy has one. An empty table gives empty results. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, shared_dir

#: Decompressed bytes after which a frame, and a bundle, is closed.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 27
LEVEL = 3
#: Payloads shorter than this are never revisits.
MIN_REVISIT = 0

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
_ENTRY = struct.Struct("<II")
_FOOTER = struct.Struct("<IBI")
_SKIP = struct.Struct("<II")


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, decompressed) sizes."""
    body = b"".join(_ENTRY.pack(*f) for f in frames) + _FOOTER.pack(len(frames), 0, SEEKABLE_MAGIC)
    return _SKIP.pack(SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(data: bytes | memoryview) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame of a bundle."""
    count, flags, magic = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
    if magic != SEEKABLE_MAGIC or flags & 0x7C:
        raise ValueError("no seek table")
    entry = _ENTRY.size + (4 if flags & 0x80 else 0)
    start = len(data) - _FOOTER.size - count * entry
    if _SKIP.unpack_from(data, start - _SKIP.size) != (SKIPPABLE_MAGIC, count * entry + _FOOTER.size):
        raise ValueError("the seek table is damaged")
    at, out = 0, []
    for i in range(count):
        packed, plain = _ENTRY.unpack_from(data, start + i * entry)
        out.append((at, packed, plain))
        at += packed
    return out


class BundleWriter:
    """Frames of records in memory, at most BUNDLE_BYTES and a record; `close` gives the bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.coder = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.parts, self.sizes, self.open, self.length, self.total = [], [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of a record."""
        if self.length and self.length + len(record) > self.frame_bytes:
            self._end_frame()
        where = len(self.sizes), self.length
        self.open.append(record)
        self.length += len(record)
        self.total += len(record)
        return where

    def _end_frame(self) -> None:
        plain = b"".join(self.open)
        packed = self.coder.compress(plain)
        self.parts.append(packed)
        self.sizes.append((len(packed), len(plain)))
        self.open, self.length = [], 0

    def close(self) -> bytes:
        if self.open:
            self._end_frame()
        return b"".join(self.parts) + seek_table(self.sizes)


class BundleReader:
    """Random access to the frames of a bundle."""

    def __init__(self, data: bytes):
        self.data, self.frames, self.coder = memoryview(data), read_seek_table(data), zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, _ = self.frames[i]
        return self.coder.decompress(self.data[at : at + packed])

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


@dataclass(frozen=True)
class Record:
    kind: str
    uri: str
    record_id: str
    digest: str
    length: int
    refers_to: str | None
    payload: bytes

    def encode(self) -> bytes:
        head = [
            "WARC/1.1", f"WARC-Type: {self.kind}", f"WARC-Record-ID: <{self.record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {self.uri}", f"WARC-Payload-Digest: sha1:{self.digest}", f"X-Payload-Length: {self.length}",
        ]
        if self.refers_to is not None:
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{self.refers_to}>"]
        head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(self.payload)}", "", ""]
        return "\r\n".join(head).encode() + self.payload + b"\r\n\r\n"

    @classmethod
    def decode(cls, data: bytes, at: int = 0) -> tuple[Record, int]:
        """The record at an offset, and the offset after it."""
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in lines)
        length, start = int(head["Content-Length"]), end + 4
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is damaged")
        refers = head.get("WARC-Refers-To")
        return cls(head["WARC-Type"], head["WARC-Target-URI"], head["WARC-Record-ID"][1:-1], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), refers and refers[1:-1], data[start : start + length]), start + length + 4


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: object) -> str:
    return f"urn:page:{'' if page is None else page}"


def _write(batches: Iterator[pa.RecordBatch], folder: str, frame_bytes: int, bundle_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    writer, rows = BundleWriter(frame_bytes), []

    def store() -> pa.RecordBatch:
        nonlocal writer, rows
        name = f"{uuid.uuid4().hex}.warc.zst"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(writer.close())
        columns = list(zip(*rows, strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["bundle", "record_id", "frame", "offset", "length"])
        writer, rows = BundleWriter(frame_bytes), []
        return batch

    for batch in batches:
        for page, uri, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload = (html or "").encode()
            uri = "".join((uri or "").split())
            shown = base64.b32encode(bytes.fromhex(digest)).decode()
            record = Record("response" if refers is None else "revisit", uri, _urn(page), shown, len(payload), refers and _urn(refers), payload if refers is None else b"")
            data = record.encode()
            frame, offset = writer.add(data)
            rows.append((record.record_id, frame, offset, len(data)))
            if writer.total >= bundle_bytes:
                yield store()
    if rows:
        yield store()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write bundles into `folder`; the index (bundle, record_id, frame, offset, length) as a committed table."""
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("uri"), text.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    firsts = rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    marked = rows.join(materialize(firsts, "warc-firsts"), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    out = marked.select(F.col("page").cast("string").alias("page"), "uri", "html", "digest", refers.alias("refers"))
    written = out.mapInArrow(lambda it: _write(it, folder, frame_bytes, bundle_bytes), "bundle string, record_id string, frame long, offset long, length long")
    return materialize(written, "warc-index")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with fs.open_input_file(f"{base}/{name}") as f:
                reader = BundleReader(f.read())
            for i in range(len(reader.frames)):
                data, at, rows = reader.frame(i), 0, []
                while at < len(data):
                    start = at
                    record, at = Record.decode(data, at)
                    if record.kind == "response" and (len(record.payload) != record.length or sha1_base32(record.payload) != record.digest):
                        raise ValueError(f"{name}: the payload of {record.record_id} does not match its digest")
                    rows.append((name, i, start, record.kind, record.uri, record.record_id, record.digest, record.length, record.refers_to, record.payload))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                names = ["bundle", "frame", "offset", "kind", "uri", "record_id", "digest", "payload_bytes", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


RECORD_FIELDS = "bundle string, frame long, offset long, kind string, uri string, record_id string, digest string, payload_bytes long, refers_to string, payload binary"


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that the index names, payload digests verified."""
    names = materialize(index.select("bundle").distinct(), "warc-bundles")
    bundles = names.repartition(max(1, names.count()))
    if payloads:
        return bundles.mapInArrow(lambda it: _read(it, folder), RECORD_FIELDS)

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches, folder):
            yield b.select(list(range(b.num_columns - 1)))

    return bundles.mapInArrow(light, RECORD_FIELDS.rpartition(",")[0])


def read_record(folder: str, bundle: str, frame: int, offset: int, length: int) -> Record:
    """One record by its index entry: reads the seek table and one frame, not the bundle."""
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{bundle}") as f:
        size = f.size()
        count, flags, _ = _FOOTER.unpack(f.read_at(_FOOTER.size, size - _FOOTER.size))
        table = _SKIP.size + count * (_ENTRY.size + (4 if flags & 0x80 else 0)) + _FOOTER.size
        at, packed, plain = read_seek_table(f.read_at(table, size - table))[frame]
        data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at))
    return Record.decode(data[offset : offset + length])[0]


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    folder = f"{shared_dir(spark)}/tidemark/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.substr(F.col(c), F.lit(len("urn:page:") + 1)), F.lit("")).cast(kind)
    return read_archives(index, folder, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))


QUERIES = {"op6_warc": op6_warc}

#: Base32 from hexadecimal: five digits are twenty bits, four letters.
_SQL_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, {5 * g + 1}, 5))::INTEGER >> {shift}) % 32 + 1)::BIGINT, 1)" for g in range(8) for shift in (15, 10, 5, 0))

ORACLE_SQL = {
    "op6_warc": f"""
WITH s AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {_SQL_LETTERS} AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM s"""
}
