"""WARC records in ZIP archives: writer, reader and range reads.

Writer.  Every page becomes a WARC/1.1 record.  Records lie as stored (uncompressed) members
in ZIP archives of bounded size, each with an index member that lists page, offset and
length of its records.  Archives are single files, written by Spark's text writer: one row
is one file, and the line end that the writer adds is the archive's one-byte comment.

Reader.  It finds the end record, follows the ZIP64 locator where a field is at its
limit, parses the central directory, checks each local header, and reads members as
ranges of the archive.  Nothing is extracted; a record is cut out by its index entry.

Equal payloads: of the records whose payloads are equal and at least ``least_bytes`` long,
the one with the smallest page_id is a ``response``; the others are ``revisit`` records that
refer to it and carry no payload.  Equality is that of the SHA-1 digests.

Defined cases: null html is an empty payload; null page_id: its record is always a
response and is referred to by none; rows that repeat page_id and payload of a
response are responses too; extra columns are ignored; an empty
table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import arrow_batches, shared_path, small_side, stage

ARCHIVE_BYTES = 4 << 20
INDEX_NAME = "index.cdx"

# Fixed values of the ZIP format
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Stored members one after another; ZIP64 fields where a value needs them (or ``zip64``)."""

    def __init__(self, zip64: bool = False):
        self.parts, self.size, self.entries, self.zip64 = [], 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Store a member; returns the offset of its data."""
        raw, crc, at = name.encode(), zlib.crc32(data), self.size
        wide = self.zip64 or len(data) >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        n = _MAX32 if wide else len(data)
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, n, n,
                              len(raw), len(extra)) + raw + extra)
        data_at = self.size
        self._put(data)
        self.entries.append((raw, crc, len(data), at))
        return data_at

    def finish(self, comment: bytes = b"") -> bytes:
        start = self.size
        for raw, crc, n, at in self.entries:
            wide = self.zip64 or n >= _MAX32 or at >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
            n32, at32 = (_MAX32, _MAX32) if wide else (n, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, n32,
                                  n32, len(raw), len(extra), 0, 0, 0, 0, at32) + raw + extra)
        length, count = self.size - start, len(self.entries)
        if self.zip64 or count >= _MAX16 or self.size >= _MAX32:
            at64 = self.size
            self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, count, count, length, start))
            self._put(struct.pack("<IIQI", _LOCATOR64, 0, at64, 1))
            count, length, start = _MAX16, _MAX32, _MAX32
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, count, count, length, start, len(comment)) + comment)
        return b"".join(self.parts)


class ZipReader:
    """Members of an archive by ranges; ``read(offset, length)`` gives bytes of the archive."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - _MAX16)
        tail = bytes(read(tail_at, size - tail_at))
        end = tail.rfind(struct.pack("<I", _END))
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(struct.pack("<I", _END), 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if count == _MAX16 or length == _MAX32 or start == _MAX32:
            sign, _, at64, _ = struct.unpack("<IIQI", bytes(read(tail_at + end - 20, 20)))
            if sign != _LOCATOR64:
                raise ValueError("no ZIP64 locator")
            head = struct.unpack("<IQHHIIQQQQ", bytes(read(at64, 56)))
            if head[0] != _END64:
                raise ValueError("no ZIP64 end record")
            count, length, start = head[7], head[8], head[9]
        self.members = self._directory(bytes(read(start, length)), count)

    @staticmethod
    def _directory(raw: bytes, count: int) -> dict:
        members, at = {}, 0
        for _ in range(count):
            (sign, _, _, _, method, _, _, crc, packed, n, n_name, n_extra, n_note, _, _, _, offset) = struct.unpack_from(
                "<IHHHHHHIIIHHHHHII", raw, at)
            if sign != _CENTRAL:
                raise ValueError("central directory is damaged")
            name = raw[at + 46:at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name:at + 46 + n_name + n_extra]
            x = 0
            while x + 4 <= len(extra):
                kind, size = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # wide values, only of the fields that are at their limit
                    wide = list(struct.unpack_from(f"<{size // 8}Q", extra, x + 4))
                    n = wide.pop(0) if n == _MAX32 else n
                    packed = wide.pop(0) if packed == _MAX32 else packed
                    offset = wide.pop(0) if offset == _MAX32 else offset
                x += 4 + size
            if method != 0 or packed != n:
                raise ValueError(f"{name} is not stored")
            members[name] = (offset, n, crc)
            at += 46 + n_name + n_extra + n_note
        return members

    def place(self, name: str) -> tuple[int, int]:
        """(offset, length) of a member's data."""
        offset, n, _ = self.members[name]
        sign, n_name, n_extra = struct.unpack("<I22xHH", bytes(self.read(offset, 30)))
        if sign != _LOCAL:
            raise ValueError(f"no local header for {name}")
        return offset + 30 + n_name + n_extra, n

    def member(self, name: str) -> bytes:
        data = bytes(self.read(*self.place(name)))
        if zlib.crc32(data) != self.members[name][2]:
            raise ValueError(f"{name} is damaged")
        return data


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id, url, payload: bytes, digest: str, refers_to=None, refers_url=None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the payload's digest and length but not the payload."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", "" if url is None else url),
            ("Content-Type", "text/html;charset=utf-8"), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", len(block)))
    lines = "".join(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers of a record by lower-case name, and its block under ``block``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    out["block"] = rest[:int(out["content-length"])]
    return out


def _marked(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html, sha1 (hex) and refers_to: the page that a revisit refers to."""
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    named = named.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    first = (named.where((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull())
             .groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("_last"))
             .where("first < _last").select("sha1", "first"))
    first = stage(first, "warc-first")
    return named.join(small_side(first), "sha1", "left").select(
        "page_id", "url", "html", "sha1", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
                   zip64: bool = False) -> str:
    """Write all pages (page_id, url, html) as WARC records in ZIP archives; returns their folder."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            payloads = batch.column(2).cast(pa.large_binary())
            for page, url, payload, sha1, refers in zip(*[c.to_pylist() for c in (
                    batch.column(0), batch.column(1), payloads, batch.column(3), batch.column(4))]):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                held.append(warc_record(page, url, payload, digest, refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    def out(held):
        z, index, at = ZipWriter(zip64), [], 0
        z.add("records.warc", b"".join(held))
        for r in held:
            index.append(f"{at} {len(r)}\n")
            at += len(r)
        z.add(INDEX_NAME, "".join(index).encode())
        return pa.RecordBatch.from_arrays([pa.array([z.finish(b"\n")[:-1]], pa.binary())], names=["archive"])

    spark = pages.sparkSession
    path = shared_path(spark, "warc-archives")
    archives = _marked(pages, least_bytes).mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    with arrow_batches(spark, 200):
        archives.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, and with ``payloads`` the payload (empty for revisits)."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    fields += [("payload", pa.binary())] * payloads

    def page(x):
        x = x[len("<urn:page:"):-1] if x else "None"
        return None if x == "None" else int(x)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                z = ZipReader(lambda at, n, view=view: view[at:at + n], len(view))
                base, _ = z.place("records.warc")
                got = [[] for _ in fields]
                for line in z.member(INDEX_NAME).decode().splitlines():
                    at, n = map(int, line.split())
                    r = parse_record(bytes(z.read(base + at, n)))
                    digest = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["warc-type"] == "response" and payload_digest(r["block"]) != digest:
                        raise ValueError(f"payload of {r['warc-record-id']} is damaged")
                    for c, v in zip(got, (page(r["warc-record-id"]), int(r["x-payload-length"]), digest, r["warc-type"],
                                          page(r.get("warc-refers-to")), r["warc-target-uri"], r["block"])):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(got, fields)],
                                                 names=[n for n, _ in fields])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                                 "refers_to bigint, url string" + ", payload binary" * payloads)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archives and read every record back."""
    if not pages.limit(1).count():
        return pages.sparkSession.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, "
                                                      "record_type string, refers_to bigint, url string")
    return read_archives(pages.sparkSession, write_archives(pages, least_bytes), payloads=False)
