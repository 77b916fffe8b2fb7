"""WARC records in ZIP packages: a writer, and a reader that fetches records by byte ranges without extraction.

A package holds stored members: ``archive/data.warc.gz``, whose records are gzip members one after the other, and
``indexes/index.cdxj``, one JSON line per record with its offset and length in the archive member.  Every task writes its
rows to packages of its own (a new one begins at ``PACKAGE_BYTES``) in a shared folder; only packages named by tasks
that ended count, so a repeated task does no harm.

The reader parses the end record, the ZIP64 locator and end record where sizes do not fit, and the central directory with its
ZIP64 fields; the local header gives the place of a stored member's bytes.  A first pass reads directories and
indexes and deals the records into byte ranges of ``RANGE_BYTES``; a second pass, spread over all tasks, reads each range
with one read and parses its records.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest page id is written in full and the others
as revisits, which carry the payload's digest and, in their HTTP head, its length.

Defined results: a null html is an empty payload, a null url has no target URI; control characters in a url are percent-encoded; a
null id is larger than any other: it revisits a payload that some id has, and rows with no id are never revisited; rows that repeat the
smallest id with the same payload are responses each; a payload whose digest is not the stored one, a member that is not stored or a broken
directory raises ValueError; an empty table has no packages and no rows; other columns stay unread.  A task holds one
package's index (about 200 bytes for each record) and one range or one record at a time, whichever is larger.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenspark.llm.common import pandas_rows, small_side
from greenspark.operators.lineage import cut

PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
REVISIT_BYTES = 100
BROADCAST_DIGESTS = 400_000  # of 32 bytes each, so about 50 MB
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


# --- records ---

def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '/'.join(map(str, parts)))}>"


def _uri(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, place: str) -> bytes:
    """A response record, or, with ``first``, a revisit of the response of that page."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    body = head + payload if first is None else head
    fields = [("WARC-Type", "response" if first is None else "revisit"),
              ("WARC-Record-ID", _record_id(page_id, digest) if first is None else _record_id("revisit", page_id, place)),
              ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{sha256(body).hexdigest()}"),
              ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if first is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _record_id(first, digest)), ("WARC-Refers-To-Page-ID", str(first))]
    fields.append(("Content-Length", str(len(body))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in pairs if k}


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record; field names in lower case."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("a WARC record begins with its version")
    at = raw.index(b"\r\n\r\n")
    warc = _fields(raw[:at])
    block = raw[at + 4:at + 4 + int(warc["content-length"])]
    if len(block) != int(warc["content-length"]):
        raise ValueError("a WARC record is shorter than its length field")
    at = block.index(b"\r\n\r\n")
    return warc, _fields(block[:at]), block[at + 4:]


# --- packages ---

def _open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class Package:
    """One ZIP package being written: records go straight to the store, the index is added at the end."""

    def __init__(self, path: str):
        store, name = _open_store(path)
        self.sink, self.path, self.size, self.lines = store.open_output_stream(name), path, 0, []
        self.zip = zipfile.ZipFile(io.BufferedWriter(_Stream(self.sink), 1 << 20), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, record: bytes, entry: dict) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.lines.append(json.dumps(entry | {"offset": self.size, "length": len(packed)}))
        self.member.write(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        stream = self.zip.fp
        self.zip.close()
        stream.flush()
        self.sink.close()
        return self.path, len(self.lines)


class _Stream(io.RawIOBase):
    """A write-only view of a store's output stream, which cannot seek."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        return len(data)


def members(source) -> dict[str, tuple[int, int]]:
    """name -> (offset of the first byte, length) of every member of a ZIP file; members must be stored.

    ``source`` has ``size()`` and ``read_at(length, offset)``.
    """
    size = source.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = source.read_at(20, tail_at + end - 20) if tail_at + end >= 20 else b""
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        at = struct.unpack_from("<Q", locator, 8)[0]
        record = source.read_at(56, at)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory = source.read_at(length, start)
    found, at = {}, 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_note, disk = struct.unpack_from("<IIHHHH", directory, at + 20)
        offset, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode("utf-8")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        values = iter(_zip64_values(extra))
        plain = next(values) if plain == 0xFFFFFFFF else plain
        packed = next(values) if packed == 0xFFFFFFFF else packed
        offset = next(values) if offset == 0xFFFFFFFF else offset
        at += 46 + n_name + n_extra + n_note
        if name.endswith("/"):
            continue
        if method != 0 or packed != plain or disk not in (0, 0xFFFF):
            raise ValueError(f"{name} is not a stored member")
        local = source.read_at(30, offset)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        found[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return found


def _zip64_values(extra: bytes) -> list[int]:
    """The 8-byte values of the ZIP64 field, in the order of the sentinels they stand for."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return [v for v, in struct.iter_unpack("<Q", extra[at + 4:at + 4 + n // 8 * 8])]
        at += 4 + n
    return []


class StoreFile:
    """Range reads of one file of a store."""

    def __init__(self, path: str):
        store, name = _open_store(path)
        self.file = store.open_input_file(name)

    def size(self) -> int:
        return self.file.size()

    def read_at(self, length: int, offset: int) -> bytes:
        got = self.file.read_at(length, offset)
        if len(got) != length:
            raise ValueError("a range lies outside the file")
        return got


# --- Spark side ---

def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of ``pages(page_id, url, html)``; gives (path, n_records) of the packages."""
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn(
        "digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    long_ = keyed.where(F.octet_length("html") >= REVISIT_BYTES)
    firsts = cut(long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1 and first is not null").select("digest", "first"))
    marked = keyed.join(small_side(firsts, BROADCAST_DIGESTS), "digest", "left").withColumn(
        "first", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, package, done, n = TaskContext.get(), None, [], 0
        name = f"{folder}/{context.partitionId():05d}-{context.taskAttemptId()}"
        for batch in batches:
            for page_id, url, html, digest, first in pandas_rows([batch], "page_id", "url", "html", "digest", "first"):
                page_id, first = (None if v is None else int(v) for v in (page_id, first))
                if package is None:
                    package = Package(f"{name}-{len(done)}.wacz")
                n += 1
                digest = bytes(digest).hex()
                payload = html.encode("utf-8", "surrogatepass")
                package.add(record_bytes(page_id, url, payload, digest, first, f"{name}/{n}"), {
                    "url": None if url is None else _uri(url), "page_id": page_id, "digest": f"sha256:{digest}",
                    "type": "response" if first is None else "revisit", "filename": ARCHIVE})
                if package.size >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pd.DataFrame(done, columns=["path", "n_records"])

    ready = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("first").cast("string").alias("first"))
    return cut(ready.mapInPandas(write, "path string, n_records bigint"))


_RANGES = "path string, start bigint, offsets array<bigint>, lengths array<bigint>, digests array<string>"


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbouring records of a package, dealt into ranges by its index."""
    for path, in pandas_rows(batches, "path"):
        source = StoreFile(path)
        found = members(source)
        out, held, start = [], [], 0
        base, _ = found[ARCHIVE]
        at, length = found[INDEX]
        entries = sorted((e["offset"], e["length"], e["digest"]) for e in map(json.loads, source.read_at(length, at).splitlines()))
        for entry in entries:
            if held and entry[0] + entry[1] - start > RANGE_BYTES:
                out.append((path, base + start, *_columns(held, start)))
                held = []
            if not held:
                start = entry[0]
            held.append(entry)
        if held:
            out.append((path, base + start, *_columns(held, start)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _RANGES.split(", ")])


def _columns(held: list[tuple[int, int, str]], start: int) -> tuple[list[int], list[int], list[str]]:
    return [e[0] - start for e in held], [e[1] for e in held], [e[2] for e in held]


_RECORDS = ("page_id string, url string, record_type string, record_id string, refers_to_id string, refers_to string, payload_bytes bigint, "
            "payload_digest string, payload binary")


def _read_ranges(with_payload: bool):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RECORDS.split(", ")]
        for path, start, offsets, lengths, digests in pandas_rows(batches, "path", "start", "offsets", "lengths", "digests"):
            raw = StoreFile(path).read_at(int(offsets[-1] + lengths[-1]), int(start))
            out = []
            for offset, length, digest in zip(offsets, lengths, digests, strict=True):
                warc, http, payload = parse_record(zlib.decompress(raw[offset:offset + length], 31))
                kind, size = warc["warc-type"], int(http["content-length"])
                if warc["warc-payload-digest"] != digest:
                    raise ValueError(f"{path}: index and record name different payloads")
                if kind == "response" and (len(payload) != size or f"sha256:{sha256(payload).hexdigest()}" != digest):
                    raise ValueError(f"{path}: a payload differs from its digest")
                out.append((warc.get("warc-page-id"), warc.get("warc-target-uri"), kind, warc["warc-record-id"], warc.get("warc-refers-to"),
                            warc.get("warc-refers-to-page-id"), size, digest.removeprefix("sha256:"),
                            payload if with_payload and kind == "response" else None))
            yield pd.DataFrame(out, columns=names)

    return rows


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of ``packages(path)``; ``payload`` is null for revisits and without ``with_payload``."""
    spark = packages.sparkSession
    ranges = cut(packages.select("path").repartition(spark.sparkContext.defaultParallelism).mapInPandas(_ranges, _RANGES))
    return (ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
            .mapInPandas(_read_ranges(with_payload), _RECORDS)
            .withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")}))


def with_payloads(records: DataFrame) -> DataFrame:
    """``records`` with the payload of the response in the place of each revisit's missing one."""
    full = records.where("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("payload").alias("_payload")).dropDuplicates(["_id"])
    return (records.join(full, F.col("refers_to_id") == F.col("_id"), "left")
            .withColumn("payload", F.coalesce("payload", "_payload")).drop("_id", "_payload"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    cut(spark.range(0))  # sets the folder of a bare local session
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    store, name = _open_store(folder)
    store.create_dir(name, recursive=True)
    return folder


def warc_digest(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to packages, reads these back, and lists their records."""
    packages = write_packages(pages, shared_folder(pages.sparkSession))
    return read_packages(packages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
