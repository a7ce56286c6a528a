"""WARC records in ZIP packages: written by tasks, read back by ranges without extraction.

A package is a ZIP file that holds archive members (``archive/*.warc`` or ``.warc.gz``, one gzip member a record) and index members
(``indexes/*.cdx`` or ``.cdxj``, also with ``.gz``), stored, not deflated. Reading takes three steps. The end of a package gives its
central directory (ZIP64 records included, and bytes before the first member allowed), and each local header gives where a member's
bytes begin. The lines of the indexes give offset and length of each record; an archive member that no index names is walked once,
record by record. The ranges are dealt out by stretches of a package, so one large package is read by many tasks, and each task reads
only the bytes of its records. Nothing is unpacked to a folder and no member is held whole.

Writing: of pages with equal payloads of at least LEAST bytes, that with the smallest page_id gives a response record, the others
revisits that name it. The least page_id of a payload meets its pages without gathering them, however many copies there are
(``skew.with_least``). Each task writes packages of its own name and returns them; only those of tasks that were committed are listed,
so a task that ran twice, or was lost, leaves files that nothing reads.

Edge cases: a null payload is empty; a null page_id is a response, is not referred to, and reads back as null; rows that repeat the
smallest page_id of a payload are responses each; a null url is about:blank, and control characters in a url are escaped; a payload of any length is one record;
an empty table writes no package and reads as no rows; further columns are not used, whatever their names. A deflated archive or index
member is an error, as it cannot be read by ranges. A record that cannot be parsed is a row whose error says why.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from typing import Any, BinaryIO, NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.session import cut, shared
from larkspur.llm.skew import with_least

#: Bytes of the smallest payload that can be revisited; of a package's archive, at which the next package begins; of a stretch that one task reads; of a read.
LEAST, PACKAGE, STRETCH, WINDOW = 100, 1 << 30, 1 << 26, 1 << 22
ARCHIVE, INDEX = re.compile(r"archive/.+\.warc(\.gz)?"), re.compile(r"indexes/.+\.cdxj?(\.gz)?")
DATE, PROFILE = "2000-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EVERY, FULL = 0xFFFFFFFF, 0xFFFF  # what a field of 4 or 2 bytes holds if the ZIP64 record has the value


def place(uri: str) -> tuple[Any, str]:
    """The file system of a folder's or file's address, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# Writing


class Package:
    """A ZIP file of stored members written front to back, each of any length, with ZIP64 records throughout."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.at, self.members = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """A member of a size that is not known yet."""
        n = name.encode()
        self.name, self.header, self.crc = n, self.at, 0
        self.write(struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0x808, 0, 0, 0x21, 0, EVERY, EVERY, len(n), 20) + n + struct.pack("<2H2Q", 1, 16, 0, 0))
        self.start = self.at

    def add(self, data: bytes) -> int:
        """Appends to the member; where in it data begins."""
        offset, self.crc = self.at - self.start, zlib.crc32(data, self.crc)
        self.write(data)
        return offset

    def end(self) -> None:
        size = self.at - self.start
        self.members.append((self.name, self.crc, size, self.header))
        self.write(struct.pack("<4sL2Q", b"PK\7\10", self.crc, size, size))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, header in self.members:
            self.write(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0x808, 0, 0, 0x21, crc, EVERY, EVERY, len(name), 28, 0, 0, 0, 0, EVERY) + name + struct.pack("<2H3Q", 1, 24, size, size, header))
        end, n = self.at, len(self.members)
        self.write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, end - begin, begin) + struct.pack("<4sLQL", b"PK\6\7", 0, end, 1))
        self.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, FULL, FULL, EVERY, EVERY, 0))
        self.out.close()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=sha256(f'{page_id}:{digest}'.encode()).digest()[:16])}>"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in (*headers, ("Content-Length", len(block))) if v is not None)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}\r\n".encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def surt(url: str) -> str:
    """The key by which an index is sorted: the parts of the host from the last to the first, then the path."""
    try:
        u = urlsplit(url.lower())
    except ValueError:
        return url.lower()
    return ",".join(reversed((u.hostname or "").split("."))) + f"){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def write_packages(pages: DataFrame, folder: str, date: str = DATE, package: int = PACKAGE, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row into packages below folder (an address that all executors reach) and returns them: path, records, bytes. A package ends once it has so many bytes. All are written when this returns."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("about:blank")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("key", F.when(F.octet_length("html") >= LEAST, F.col("digest")))
    p = with_least(p, "key", F.col("page_id"), "least", "page_id", "digest").select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("least"), F.col("least")).alias("refers_to"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        fs.create_dir(root, recursive=True)
        lines: list[str] = []
        zipped = name = None

        def finished() -> pa.RecordBatch:
            zipped.end()
            zipped.begin("indexes/index.cdx")
            for line in sorted(lines):
                zipped.add(line.encode())
            zipped.end()
            zipped.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.zip"], "records": [len(lines)], "bytes": [zipped.at]})

        for batch in batches:
            for k in range(batch.num_rows):
                page, address, text, digest, refers = (c[k].as_py() for c in batch.columns)
                if zipped is None:
                    name, lines = uuid.uuid4().hex, []
                    zipped = Package(fs.open_output_stream(f"{root}/{name}.zip"))
                    zipped.begin("archive/data.warc.gz")
                    zipped.add(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                address, payload = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", address), text.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", address)]
                headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Page-ID", page)]
                if refers is not None:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, digest)), ("WARC-Refers-To-Page-ID", refers)]
                data = record(headers, http + payload if refers is None else http)
                entry = {"url": address, "mime": "text/html" if refers is None else "warc/revisit", "status": 200, "digest": f"sha256:{digest}", "length": len(data), "offset": zipped.add(data), "filename": "data.warc.gz"}
                lines.append(f"{surt(address)} {re.sub('[^0-9]', '', date)} {json.dumps(entry)}\n")
                if zipped.at >= package:
                    yield finished()
                    zipped = None
        if zipped:
            yield finished()

    return cut(p.mapInArrow(task, "path string, records long, bytes long"))


# Reading


class Member(NamedTuple):
    name: str
    method: int
    start: int
    size: int


class Ranges:
    """A file that is read in windows, forward or at any place; bytes counts what was read."""

    def __init__(self, path: str) -> None:
        fs, at = place(path)
        self.file = fs.open_input_file(at)
        self.size, self.begin, self.held, self.bytes = self.file.size(), 0, b"", 0

    def get(self, start: int, length: int, ahead: int = 0) -> bytes:
        if start < 0 or start + length > self.size:
            raise ValueError("a range outside the file")
        if not (self.begin <= start and start + length <= self.begin + len(self.held)):
            self.begin, self.held = start, self.file.read_at(min(max(length, ahead), self.size - start), start)
            self.bytes += len(self.held)
        return self.held[start - self.begin : start - self.begin + length]

    def stream(self, start: int, size: int) -> Iterator[bytes]:
        for at in range(start, start + size, WINDOW):
            yield self.get(at, min(WINDOW, start + size - at))


def directory(f: Ranges) -> Iterator[Member]:
    """The archive and index members of a ZIP file, from the directory at its end."""
    tail = f.get(max(0, f.size - 22 - FULL), min(f.size, 22 + FULL))
    at = len(tail) - 22
    while at >= 0 and not (tail[at : at + 4] == b"PK\5\6" and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at + 3)
    if at < 0:
        raise ValueError("no directory of a ZIP file")
    n, size, offset = struct.unpack("<H2L", tail[at + 10 : at + 20])
    end = f.size - len(tail) + at
    if n == FULL or EVERY in (size, offset):
        mark, _, there, _ = struct.unpack("<4sLQL", f.get(end - 20, 20))
        if mark == b"PK\6\7":
            # what stands before the first member shifts all offsets, this one too
            end = there if f.get(there, 4) == b"PK\6\6" else end - 20 - 56
            mark, *_, n, size, offset = struct.unpack("<4sQ2H2L4Q", f.get(end, 56))
            if mark != b"PK\6\6":
                raise ValueError("no ZIP64 record where the locator points to")
    before, at = end - size - offset, end - size
    found = []
    for _ in range(n):
        _, _, _, flags, method, _, _, _, packed, full, names, extras, comments, _, _, _, header = struct.unpack("<4s6H3L5H2L", f.get(at, 46, WINDOW))
        rest = f.get(at + 46, names + extras, WINDOW)
        at += 46 + names + extras + comments
        name, extra = rest[:names].decode("utf-8" if flags & 0x800 else "cp437"), rest[names:]
        while len(extra) >= 4:
            kind, long = struct.unpack("<2H", extra[:4])
            if kind == 1:
                values = iter(struct.unpack(f"<{long // 8}Q", extra[4 : 4 + long // 8 * 8]))
                full, packed, header = (next(values) if x == EVERY else x for x in (full, packed, header))
            extra = extra[4 + long :]
        if ARCHIVE.fullmatch(name) or INDEX.fullmatch(name):
            found.append((name, method, before + header, packed))
    for name, method, header, packed in sorted(found, key=lambda m: m[2]):
        mark, names, extras = struct.unpack("<4s22x2H", f.get(header, 30))
        if mark != b"PK\3\4":
            raise ValueError(f"no member where the directory has {name}")
        yield Member(name, method, header + 30 + names + extras, packed)


def lines(f: Ranges, m: Member) -> Iterator[bytes]:
    """The lines of a stored member, unzipped if its name ends in .gz."""
    z, rest = zlib.decompressobj(31) if m.name.endswith(".gz") else None, b""
    for data in f.stream(m.start, m.size):
        out = b"" if z else data
        while z and data:
            out += z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
        *whole, rest = (rest + out).split(b"\n")
        yield from whole
    if rest:
        yield rest


def walked(f: Ranges, m: Member) -> Iterator[tuple[int, int]]:
    """Start and length of each record of an archive member, found by passing over it once."""
    at, end = m.start, m.start + m.size
    while at < end:
        begin = at
        if m.name.endswith(".gz"):
            z = zlib.decompressobj(31)
            while not z.eof:
                data = f.get(at, min(WINDOW, end - at), WINDOW)
                if not (z.decompress(data, WINDOW) or data or z.eof):  # to a bounded length at a time, whatever it unpacks to
                    raise ValueError("a member ends within a record")
                at += len(data) - len(z.unconsumed_tail) - len(z.unused_data)
        else:
            head = f.get(at, min(1 << 16, end - at), WINDOW)
            size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head[: head.find(b"\r\n\r\n") + 4])
            if not size:
                raise ValueError("a record without a length")
            at = min(end, at + head.find(b"\r\n\r\n") + 8 + int(size[1]))
        yield begin, at - begin


def layout(path: str) -> Iterator[tuple[str, int, int]]:
    """Member, start in the package and length of each record that a package holds."""
    f = Ranges(path)
    members = list(directory(f))
    if wrong := [m.name for m in members if m.method]:
        raise ValueError(f"{path}: members that are not stored cannot be read by ranges: {', '.join(wrong)}")
    archives = {m.name: m for m in members if ARCHIVE.fullmatch(m.name)}
    short, named = {name.rsplit("/", 1)[-1]: m for name, m in archives.items()}, set()
    for m in members:
        for line in lines(f, m) if INDEX.fullmatch(m.name) else ():
            if (at := line.find(b"{")) >= 0:
                entry = json.loads(line[at:])
                archive = archives.get(entry["filename"]) or short[entry["filename"].rsplit("/", 1)[-1]]
                named.add(archive.name)
                yield archive.name, archive.start + int(entry["offset"]), int(entry["length"])
    for m in archives.values():
        if m.name not in named:
            yield from ((m.name, *x) for x in walked(f, m))


def fields(head: bytes) -> list[tuple[str, str]]:
    """Header lines as pairs, names in lower case, the last of repeated names."""
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return list({k.strip().lower(): v.strip() for k, v in pairs}.items())


def parsed(data: bytes, zipped: bool) -> tuple:
    """(headers, http_headers, payload) of a record; without HTTP the payload is the block."""
    data = zlib.decompress(data, 31) if zipped else data
    head, found, rest = data.partition(b"\r\n\r\n")
    if not (found and head.startswith(b"WARC/")):
        raise ValueError("not a record")
    headers = fields(head)
    size = int(dict(headers)["content-length"])
    if size > len(rest):
        raise ValueError("a block shorter than its length")
    block, http = rest[:size], None
    if dict(headers).get("content-type", "").startswith("application/http"):
        head, _, block = block.partition(b"\r\n\r\n")
        http = fields(head)
    return headers, http, block


PAIRS = T.MapType(T.StringType(), T.StringType())
RECORD = T.StructType().add("path", T.StringType()).add("start", T.LongType()).add("length", T.LongType()).add("headers", PAIRS).add("http_headers", PAIRS).add("payload", T.BinaryType()).add("error", T.StringType())


def locate(packages: DataFrame, path: str = "path") -> DataFrame:
    """path, member, start and length of every record in packages (one address a row), by directory and index, without reading the records of archives that have an index."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                rows = []
                for member, start, length in layout(p):
                    rows.append({"path": p, "member": member, "start": start, "length": length})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    names = packages.where(F.col(path).isNotNull()).select(F.col(path).alias("path"))
    return names.repartition("path").mapInArrow(task, "path string, member string, start long, length long")


def read_records(located: DataFrame) -> DataFrame:
    """The records that rows of locate point to: path, start, length, headers and http_headers (names in lower case), payload, error (null if the record could be read)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = at = None
        arrow = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string())])
        for batch in batches:
            rows, held = [], 0
            for path, member, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != at:
                    f, at = Ranges(path), path
                try:
                    headers, http, payload = parsed(f.get(start, length, WINDOW), member.endswith(".gz"))
                    error = None
                except (ValueError, KeyError, zlib.error) as e:
                    headers, http, payload, error = None, None, None, str(e)
                rows.append(dict(zip(arrow.names, (path, start, length, headers, http, payload, error), strict=True)))
                held += len(payload or b"")
                if held > WINDOW or len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    stretch = (F.col("start") / STRETCH).cast("long")
    tasks = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a set number: rows of located are small, what they point to is not
    dealt = located.select("path", "member", "start", "length").repartition(tasks, "path", stretch).sortWithinPartitions("path", "start")
    return dealt.mapInArrow(task, RECORD)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared(spark)}/warc-{uuid.uuid4().hex}")
    r = read_records(locate(packages))
    kind, own = F.element_at("headers", "warc-type"), F.element_at("headers", "warc-payload-digest")
    return r.select(
        F.element_at("headers", "warc-page-id").cast("long").alias("page_id"),
        F.when(kind == "revisit", F.element_at("http_headers", "content-length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(kind == "revisit", F.substring_index(own, ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        kind.alias("record_type"),
        F.element_at("headers", "warc-refers-to-page-id").cast("long").alias("refers_to"),
    )


OP13_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(octet_length(encode(html)) as bigint) as n, sha256(html) as digest from p),
m as (select *, min(page_id) over (partition by digest) as least from d)
select page_id, n as payload_bytes, digest as payload_digest, case when n >= 100 and page_id > least then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > least then least end as refers_to
from m
"""
