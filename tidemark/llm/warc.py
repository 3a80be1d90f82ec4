"""WARC records inside ZIP packages, read by ranges without extraction (operator 3).

``write_archives`` packs rows as WARC records (one gzip member each) into ZIP files with two stored members: the
records and their index. ``read_archives`` opens each package by its end-of-central-directory record (ZIP64
included), walks the central directory, locates the stored members, reads the index and then only the byte
ranges of records. Files are reached through pyarrow's file systems, so any URI that it knows can hold them.

A lost executor costs nothing: each attempt of a task writes files under names of its own, renames them when they
are whole, and only names that a finished task reported are ever read.

Payload rule: of records with equal payloads of at least LEAST_REVISIT bytes the one with the smallest id is a
response and the others are revisits of it; smaller payloads are always responses.

Defined cases: a null payload is empty; a null id is a response unless a row with an id has the same payload of
that size; repeated rows with the smallest id are all responses; null URLs become empty; a very long
payload is one record, in a package of its own where it is larger than that; an empty table gives no
archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, plan_bytes, quoted, raw_texts, shared_path, steps

LEAST_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_AHEAD = 1 << 20

# ---------------------------------------------------------------- ZIP

_LOCAL, _CENTRAL, _END, _END64, _LOCATE64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int  # offset of the local header


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """A ZIP package of stored members, piece by piece; ZIP64 structures where needed or asked for."""
    at, central = 0, []
    for name, data in members:
        raw, crc, big = name.encode(), zlib.crc32(data), zip64 or len(data) >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        short = _MAX32 if big else len(data)
        head = struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if big else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra
        far = zip64 or at >= _MAX32
        more = (struct.pack("<QQ", len(data), len(data)) if big else b"") + (struct.pack("<Q", at) if far else b"")
        more = struct.pack("<HH", 1, len(more)) + more if more else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if big or far else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(more), 0, 0, 0, 0, _MAX32 if far else at) + raw + more)
        yield head
        yield data
        at += len(head) + len(data)
    directory = b"".join(central)
    yield directory
    if zip64 or at >= _MAX32 or len(central) >= _MAX16:
        yield struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, len(central), len(central), len(directory), at)
        yield struct.pack("<IIQI", _LOCATE64, 0, at + len(directory), 1)
        yield struct.pack("<IHHHHIIH", _END, 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0)
    else:
        yield struct.pack("<IHHHHIIH", _END, 0, 0, len(central), len(central), len(directory), at, 0)


class Package:
    """Random access to a ZIP package through a file with seek and read."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}

    def range(self, start: int, length: int) -> bytes:
        if start < 0 or start + length > self.size:
            raise ValueError(f"range {start}+{length} is outside the package of {self.size} bytes")
        self.file.seek(start)
        return self.file.read(length)

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.size - 22 - _MAX16)
        tail = self.range(tail_at, self.size - tail_at)
        end = tail.rfind(struct.pack("<I", _END))
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
            end = tail.rfind(struct.pack("<I", _END), 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if _MAX16 == count or _MAX32 in (length, start):
            mark, _, at64, _ = struct.unpack("<IIQI", self.range(tail_at + end - 20, 20))
            if mark != _LOCATE64:
                raise ValueError("no ZIP64 locator")
            fields = struct.unpack("<IQHHIIQQQQ", self.range(at64, 56))
            if fields[0] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = fields[7:10]
        data, at, out = self.range(start, length), 0, []
        for _ in range(count):
            mark, _, _, _, method, _, _, crc, packed, size, n, e, c, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if mark != _CENTRAL:
                raise ValueError("bad central directory entry")
            name, extra = data[at + 46 : at + 46 + n].decode("utf-8"), data[at + 46 + n : at + 46 + n + e]
            while len(extra) >= 4:
                kind, k = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                    size, packed, header = (next(wide) if x == _MAX32 else x for x in (size, packed, header))
                extra = extra[4 + k :]
            out.append(Member(name, method, crc, packed, size, header))
            at += 46 + n + e + c
        return out

    def start(self, name: str) -> int:
        """Offset of the first byte of a stored member."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        head = struct.unpack("<IHHHHHIIIHH", self.range(member.header, 30))
        if head[0] != _LOCAL:
            raise ValueError("bad local header")
        return member.header + 30 + head[9] + head[10]


# ---------------------------------------------------------------- WARC


def record_bytes(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 2024-01-01T00:00:00Z", "WARC-Target-URI: " + "".join(c if 32 < ord(c) < 127 else f"%{b:02X}" for c in url for b in ([0] if 32 < ord(c) < 127 else c.encode("utf-8", "replace"))),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("short record")
    return fields, rest[:size]


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _writer(root: str):
    def write(batches):
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        blob, index, count, at = [], [], 0, 0

        def close():
            name = f"{base}/{uuid.uuid4().hex}"
            with files.open_output_stream(name + ".part") as out:
                size = 0
                for piece in zip_bytes([(RECORDS, b"".join(blob)), (INDEX, "".join(index).encode())]):
                    out.write(piece)
                    size += len(piece)
            files.move(name + ".part", name + ".wacz")
            return pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2] + ".wacz"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["name", "records", "bytes"])

        for batch in batches:
            for step in steps([batch], "payload"):
                rows = zip(step.column("id").to_pylist(), step.column("url").to_pylist(), raw_texts(step.column("payload")), step.column("digest").to_pylist(), step.column("first").to_pylist())
                for page, url, payload, digest, first in rows:
                    revisit = first is not None and page != first
                    packed = gzip.compress(record_bytes(page, url or "", payload, digest, first, revisit), 3, mtime=0)
                    blob.append(packed)
                    index.append(json.dumps({"id": page, "offset": at, "length": len(packed)}) + "\n")
                    count, at = count + 1, at + len(packed)
                    if at >= ARCHIVE_BYTES:
                        yield close()
                        blob, index, count, at = [], [], 0, 0
        if count:
            yield close()

    return write


def write_archives(df: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes df's rows as records of packages under root; returns the manifest: name, records, bytes."""
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).cast("string").alias("url"), F.coalesce(quoted(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    found = rows.join(first, (F.col("digest") == F.col("d")), "left").select("id", "url", "payload", "digest", "first")
    return materialise(found.mapInArrow(_writer(root), "name string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """Every record of the listed packages: id, url, record_type, payload_bytes, payload_digest, refers_to, payload
    (null for revisits). Digests of responses are checked against their payloads."""

    def read(batches):
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, size in zip(batch.column("name").to_pylist(), batch.column("bytes").to_pylist()):
                with files.open_input_file(f"{base}/{name}") as file:
                    package = Package(file, size)
                    at = package.start(INDEX)
                    entries = [json.loads(x) for x in package.range(at, package.members[INDEX].size).splitlines()]
                    data = package.start(RECORDS)
                    while entries:
                        some, total = [], 0
                        while entries and (not some or total + entries[0]["length"] <= READ_AHEAD):  # neighbours share a range
                            some.append(entries.pop(0))
                            total += some[-1]["length"]
                        buffer, origin, out = package.range(data + some[0]["offset"], total), some[0]["offset"], []
                        for e in some:
                            fields, block = parse_record(gzip.decompress(buffer[e["offset"] - origin : e["offset"] - origin + e["length"]]))
                            http, _, payload = block.partition(b"\r\n\r\n")
                            lengths = [int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"]
                            digest = fields["warc-payload-digest"].removeprefix("sha256:")
                            kind = fields["warc-type"]
                            if kind == "response" and (len(payload) != lengths[0] or hashlib.sha256(payload).hexdigest() != digest):
                                raise ValueError(f"damaged record {fields['warc-record-id']} in {name}")
                            out.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri", ""), kind, lengths[0], digest, _page(fields.get("warc-refers-to")), payload if with_payload and kind == "response" else None))
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    tasks = max(12, -(-plan_bytes(manifest) // 512))
    dealt = manifest.select("name", "bytes").repartition(min(tasks, 100_000), "name")
    return dealt.mapInArrow(read, "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes df to packages in the shared folder and reads them back: one row per record, without payloads."""
    root = shared_path(df.sparkSession, "warc")
    back = read_archives(write_archives(df, root, id_col, url_col, payload_col), root, with_payload=False)
    return back.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d
"""
