"""WARC archives as a PySpark Python data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Planning lists the files and cuts large ones into byte ranges. A task reads a record's headers first, from the start of its gzip member; the
pushed predicates on record type and headers decide then whether the payload is decoded. Written members carry their compressed
length in the gzip extra field ``sl``, so a record that is not wanted is skipped by a seek, and a range finds its first member by that field; members
of other writers are read through to find their end, and their files are not cut. With the option ``payload`` "false" no payload is decoded.

Each task writes a file of its own under a name that readers ignore; the commit renames the files of the tasks that count, so a lost
or repeated task leaves no records.

Defined results: null payloads are empty; a null target or reference has no header; line ends and other control characters in a target
are percent-encoded; of equal payloads of at least ``REVISIT_BYTES`` that with the smallest id is the response (rows that
repeat it too), rows with a null id are always responses; an empty table gives an archive without records and an empty result; further columns
are not read.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from ..session import scratch_path

# The planner's own workers do not see code that was sent to the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REVISIT_BYTES = 100
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
LEVEL = 4
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, content_length long, payload binary"
# Header names of the columns, and the profile of a revisit.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_length": "Content-Length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08\x04"
FIELD, FIELD_SIZE = "<HccHII", 14  # extra length, "s", "l", field length, compressed and plain length of the member


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def member(record: bytes, level: int = LEVEL) -> bytes:
    """One gzip member that states its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + FIELD_SIZE + len(body) + 8
    extra = struct.pack(FIELD, FIELD_SIZE - 2, b"s", b"l", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return MAGIC + bytes(4) + b"\x00\xff" + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"]))
    if revisit:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def header_row(headers: dict[str, str]) -> dict:
    row = {c: headers.get(name.lower()) for c, name in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c] and row[c].strip("<>")
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].rpartition(":")[2].lower()
    row["content_length"] = int(row["content_length"] or 0)
    return row


class Records:
    """Records of a file from ``start`` on that begin before ``end``: headers first, payload on demand."""

    def __init__(self, file, size: int, start: int, end: int, packed: bool):
        self.file, self.size, self.at, self.end, self.packed = file, size, start, end, packed
        self.decoded = 0  # payload bytes that were decoded
        if packed and start:
            self.at = self._next_member(start)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _length(self, at: int) -> int:
        """Compressed length that the member at ``at`` states; 0 if it states none."""
        head = self._read(at, 10 + FIELD_SIZE)
        if len(head) < 10 + FIELD_SIZE or head[:4] != MAGIC:
            return 0
        _, s, l, n, size, _ = struct.unpack_from(FIELD, head, 10)
        return size if (s, l, n) == (b"s", b"l", 8) else 0

    def _next_member(self, at: int) -> int:
        while at < self.end:
            chunk = self._read(at, 1 << 20)
            found = chunk.find(MAGIC)
            while found >= 0:
                if self._length(at + found):
                    begin = zlib.decompressobj(31)
                    try:
                        if begin.decompress(self._read(at + found, 512), 6) == b"WARC/1":
                            return at + found
                    except zlib.error:
                        pass
                found = chunk.find(MAGIC, found + 1)
            at += max(1, len(chunk) - 3)
        return self.size

    def __iter__(self) -> Iterator[tuple[dict, Opened]]:
        while self.at < min(self.end, self.size):
            opened = Opened(self, self.at)
            if opened.headers is None:
                return
            yield header_row(opened.headers), opened
            self.at = opened.close()


class Opened:
    """A record whose headers are read."""

    def __init__(self, owner: Records, at: int):
        self.owner, self.begin, self.read_to = owner, at, at
        self.length = owner._length(at) if owner.packed else 0
        self.unpack = zlib.decompressobj(31) if owner.packed else None
        self.buffer = b""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more(4096):
                break
        start = self.buffer.lstrip(b"\r\n")
        self.headers = parse_headers(self.buffer[:end].lstrip(b"\r\n")) if end >= 0 and start.startswith(b"WARC/") else None
        self.block_at = end + 4

    def _more(self, n: int) -> bool:
        """Adds about ``n`` bytes to the buffer."""
        if self.unpack is None:
            data = self.owner._read(self.read_to, n)
            self.read_to += len(data)
            self.buffer += data
            return bool(data)
        while not self.unpack.eof:
            data = self.unpack.unconsumed_tail
            if not data:
                data = self.owner._read(self.read_to, max(n, 4096))
                self.read_to += len(data)
                if not data:
                    return False
            out = self.unpack.decompress(data, n)
            if out:
                self.buffer += out
                return True
        return False

    def block(self) -> bytes:
        n = int(self.headers.get("content-length") or 0)
        while len(self.buffer) < self.block_at + n:
            if not self._more(self.block_at + n - len(self.buffer)):
                break
        return self.buffer[self.block_at : self.block_at + n]

    def http(self) -> bytes:
        """The head of an HTTP block."""
        if "application/http" not in (self.headers.get("content-type") or ""):
            return b""
        n = int(self.headers.get("content-length") or 0)
        while (end := self.buffer.find(b"\r\n\r\n", self.block_at)) < 0 and len(self.buffer) < self.block_at + n:
            if not self._more(4096):
                break
        return self.buffer[self.block_at : end + 4] if end >= 0 else b""

    def payload(self) -> bytes:
        head = self.http()
        body = self.block()[len(head) :]
        self.owner.decoded += len(body)
        return body

    def close(self) -> int:
        """Where the next record begins."""
        if self.unpack is None:
            at = self.begin + self.block_at + int(self.headers.get("content-length") or 0)
            while self.owner._read(at, 2) == b"\r\n":
                at += 2
            return at
        if self.length:
            return self.begin + self.length
        while not self.unpack.eof:  # a member that does not state its length is read through
            self.buffer = b""
            if not self._more(1 << 16):
                break
        return self.read_to - len(self.unpack.unused_data)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


OPERATORS = {"EqualTo": lambda v, x: v == x, "In": lambda v, x: v in x, "StringStartsWith": lambda v, x: v.startswith(x), "GreaterThan": lambda v, x: v > x, "GreaterThanOrEqual": lambda v, x: v >= x, "LessThan": lambda v, x: v < x, "LessThanOrEqual": lambda v, x: v <= x, "IsNotNull": lambda v, x: True}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)
        for f in filters:
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((type(f).__name__, f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, root = filesystem(self.path)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            if info.size and not info.base_name.startswith(("_", ".")) and info.base_name.endswith((".warc", ".warc.gz")):
                step = info.size
                if info.size > self.split and info.base_name.endswith(".gz"):
                    with fs.open_input_file(info.path) as file:
                        if Records(file, info.size, 0, info.size, True)._length(0):
                            step = self.split
                out += [Range(info.path, at, min(at + step, info.size), info.size) for at in range(0, info.size, step)]
        return out or [Range("", 0, 0, 0)]

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None and OPERATORS[op](row[c], x) for op, c, x in self.tests)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = filesystem(self.path)
        types = {"payload_length": pa.int64(), "content_length": pa.int64(), "payload": pa.binary()}
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows: list[dict] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names)

        with fs.open_input_file(part.path) as file:
            for row, record in Records(file, part.size, part.start, part.end, part.path.endswith(".gz")):
                if not self.wanted(row):
                    continue
                head = parse_headers(record.http())
                row["payload"] = record.payload() if self.payload else None
                stated = head.get("content-length")
                row["payload_length"] = int(stated) if stated else len(row["payload"]) if self.payload else None
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size >= BATCH_BYTES:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        hidden, final = f"{root}/_{name}.tmp", f"{root}/part-{name}.warc.gz"
        with fs.open_output_stream(hidden, compression=None) as file:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for row in batch.slice(at, 256).to_pylist():
                        file.write(member(record_bytes(row)))
        return Written(hidden, final)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(root)):
                if info.base_name.endswith(".warc.gz"):
                    fs.delete_file(info.path)
        for m in messages:
            if m:
                fs.move(m.hidden, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            if m and fs.get_file_info(m.hidden).is_file:
                fs.delete_file(m.hidden)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def page_records(pages: DataFrame, page_id: Column, url: Column, html: Column) -> DataFrame:
    """Rows in the archive's schema: responses with their payload, revisits without.

    Only digests that occur more than once are joined back, as one small row each; the pages' side of a hot digest can be split.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    rows = pages.select(page_id.cast("long").alias("page_id"), url.alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    repeated = rows.filter(F.col("payload_length") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("payload_digest").alias("digest"), "first")
    joined = rows.join(repeated, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        name(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(revisit, name(F.col("first"))).alias("refers_to"),
        "payload_digest", "payload_length", F.lit(0).cast("long").alias("content_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page; digests and lengths of responses are taken from the payloads that were read."""
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    responses = spark.read.format("warc").load(path).filter("record_type = 'response'").select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    revisits = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'").select("record_id", "record_type", "refers_to", F.col("payload_length").alias("payload_bytes"), "payload_digest")
    return responses.union(revisits).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, page_id: Column, url: Column, html: Column) -> DataFrame:
    """Writes an archive below the shared folder and reads it back."""
    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    page_records(pages, page_id, url, html).write.format("warc").mode("append").save(path)
    return read_pages(spark, path)
