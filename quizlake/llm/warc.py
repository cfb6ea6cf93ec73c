"""WARC records in ZIP packages: a writer, and a reader that parses the ZIP directories and reads single ranges.

A package is a ZIP of stored members: archive/data.warc.gz (one gzip member per record), indexes/index.cdx (one line per
record: page, offset and length inside the archive) and datapackage.json.  The reader works on a function that reads a
range, (offset, length) -> bytes.  It finds the end-of-central-directory record, goes on to the ZIP64 record where a
field is full, parses the central directory and the local headers, reads the index members and then one range per
record; nothing is extracted.  Packages are rows (package, content) so that they travel through any store Spark knows;
read_packages also takes what spark.read.format("binaryFile") gives.

Of pages with equal payloads the smallest page_id is the response and the others revisit it; ties and repeated rows
of one id: the first is the response, the others revisit it.  Null html is an empty payload.  Payloads below
min_revisit_bytes are always responses.  A null page_id sorts last.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, prepare

PACKAGE_BYTES, SALTS, LEVEL = 4 << 20, 16, 3
DATE = "2024-01-01T00:00:00Z"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with an HTTP response block; a revisit holds no payload."""
    body = payload if kind == "response" else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []), "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record: headers, payload and the length that its HTTP header gives."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "payload_bytes": told}


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def pack(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; zip64: with ZIP64 fields even where they are not needed."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        big = zip64 or len(data) >= FULL32 or at >= FULL32
        size = FULL32 if big else len(data)
        local = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        fixed = (45 if big else 20, 0x800, 0, 0, 0x5821, crc, size, size, len(raw))
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, *fixed, len(local)) + raw + local + data
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, *fixed, len(extra), 0, 0, 0, 0, FULL32 if big else at) + raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64 or at >= FULL32 or n >= FULL16:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), at) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        n, at = FULL16, FULL32
    return bytes(out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, min(len(central), FULL32), at, 0))


def directory(read, size: int) -> list[dict]:
    """The members of a ZIP of so many bytes: name, method, sizes, CRC and where the data begins."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    i = tail.rfind(b"PK\x05\x06")
    if i < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, at, _ = struct.unpack_from("<IHHHHIIH", tail, i)
    if n == FULL16 or at == FULL32 or length == FULL32:
        sign, _, where, _ = struct.unpack("<IIQI", read(tail_at + i - 20, 20))
        if sign != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        sign, _, _, _, _, _, _, n, length, at = struct.unpack("<IQHHIIQQQQ", read(where, 56))
        if sign != 0x06064B50:
            raise ValueError("no ZIP64 end of central directory")
    central, p, found = read(at, length), 0, []
    for _ in range(n):
        sign, _, _, _, method, _, _, crc, packed, full, n_name, n_extra, n_note, _, _, _, where = struct.unpack_from("<IHHHHHHIIIHHHHHII", central, p)
        if sign != 0x02014B50:
            raise ValueError("broken central directory")
        name = central[p + 46 : p + 46 + n_name].decode()
        extra, q = central[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, step = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                more = iter(struct.unpack_from(f"<{step // 8}Q", extra, q + 4))
                full = next(more) if full == FULL32 else full
                packed = next(more) if packed == FULL32 else packed
                where = next(more) if where == FULL32 else where
            q += 4 + step
        head = read(where, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        found.append({"name": name, "method": method, "size": full, "packed": packed, "crc": crc, "start": where + 30 + sum(struct.unpack_from("<HH", head, 26))})
        p += 46 + n_name + n_extra + n_note
    return found


def records(read, size: int):
    """The parsed records of a package, each by one range of its stored archive, as its index lists them."""
    members = {m["name"]: m for m in directory(read, size)}
    for name, m in members.items():
        if name.startswith("indexes/"):
            lines = read(m["start"], m["size"])
            if m["method"] or zlib.crc32(lines) != m["crc"]:
                raise ValueError(f"{name} is not stored whole")
            for line in lines.decode().splitlines():
                archive, offset, length = line.rsplit(" ", 3)[1:]
                of = members[f"archive/{archive}"]
                if of["method"]:
                    raise ValueError(f"{archive} is not stored")
                yield parse(zlib.decompress(read(of["start"] + int(offset), int(length)), 31))


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to, the smallest page_id of an equal payload, null for responses.

    A payload that a third of all pages share is met by partial aggregation and by a salted join."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_sha", F.sha1(F.col("html").cast("binary"))).withColumn("_key", F.struct(F.col("page_id").isNull().alias("null"), "page_id", "_row"))
    first = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy(F.col("_sha").alias("_first_sha")).agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = first.withColumn("_first_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", (F.pmod(F.xxhash64("_row"), F.lit(SALTS))).cast("int"))
    out = rows.join(first, (F.col("_sha") == F.col("_first_sha")) & (F.col("_salt") == F.col("_first_salt")), "left")
    again = F.col("_first").isNotNull() & (F.col("_first") != F.col("_key"))
    return out.select("page_id", "url", "html", again.alias("again"), F.when(again, F.col("_first.page_id")).alias("refers_to"))


def write_packages(pages: DataFrame, min_revisit_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Rows (package, content): ZIP packages of about package_bytes, at most; a task holds one at a time."""
    spark = pages.sparkSession
    prepare(spark)

    def run(batches):
        from pyspark import TaskContext

        part, n, out, lines = TaskContext.get().partitionId(), 0, bytearray(), []

        def closed():
            content = pack([("archive/data.warc.gz", bytes(out)), ("indexes/index.cdx", "".join(lines).encode()), ("datapackage.json", b'{"profile":"data-package","wacz_version":"1.1.1"}')], zip64=True)
            return pa.RecordBatch.from_pydict({"package": [f"{part:06d}-{n:06d}.wacz"], "content": pa.array([content], pa.large_binary())}, schema=pa.schema([("package", pa.string()), ("content", pa.binary())])) if len(content) < 2**31 else None

        for batch in batches:
            for row in batch.to_pylist():
                data = gz(record("revisit" if row["again"] else "response", row["page_id"], row["url"], row["html"].encode(), row["refers_to"]))
                if out and len(out) + len(data) > package_bytes:
                    yield closed()
                    n, out, lines = n + 1, bytearray(), []
                lines.append(f"{row['page_id']} data.warc.gz {len(out)} {len(data)}\n")
                out += data
        if out:
            yield closed()

    return revisits(pages, min_revisit_bytes).mapInArrow(run, "package string, content binary")


def read_packages(packages: DataFrame, column: str = "content") -> DataFrame:
    """One row for each record of the packages in a binary column: page_id, url, html and what the contract asks."""
    prepare(packages.sparkSession)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data, rows = memoryview(content.as_buffer()), []
                for r in records(lambda at, n, data=data: bytes(data[at : at + n]), len(data)):
                    told = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["warc-type"] == "response" and digest(r["payload"]) != told:
                        raise ValueError(f"{r['warc-record-id']}: the payload is not what its digest says")
                    number = lambda key, r=r: None if (x := r[key][10:-1]) == "None" else int(x)
                    revisit = r["warc-type"] == "revisit"
                    rows.append({"page_id": number("warc-record-id"), "url": r["warc-target-uri"], "html": None if revisit else r["payload"].decode(), "payload_bytes": r["payload_bytes"], "payload_digest": told, "record_type": r["warc-type"], "refers_to": number("warc-refers-to") if revisit else None})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return packages.select(column).mapInArrow(run, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the packages to the shared folder and reads them back."""
    scratch = Scratch(pages.sparkSession)
    return read_packages(scratch.table(write_packages(pages, min_revisit_bytes), "packages"))
