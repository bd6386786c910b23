"""WARC records in ZIP archives, written and read by range.

An archive is a ZIP file of stored members: archive/data.warc.gz (one gzip member a record),
indexes/index.jsonl (id, offset, length of each record in that member) and datapackage.json. It is written
from start to end without seeking, so sizes follow the data and the directory is in ZIP64 form throughout.
The reader takes the end of the file, finds the (ZIP64) end record, parses the central directory, locates the stored
members by their local headers, reads the index and then ranges of records; nothing is extracted.

Of pages with equal payloads of at least `min_bytes` the one with the largest id is the response,
the others are revisits that refer to it; a revisit keeps the HTTP header and so the payload's length.
Digests meet first: SHA-1 and largest id are aggregated without the payloads, repeated digests are
joined with (id, digest), and only then the payloads are dealt by (id, digest) to their archives, so
a payload that a third of all pages share moves no more than once a page, evenly.

Defined cases: null payloads are empty ones; a null id comes before all others and is read back as null; repeated
rows of one id and payload are alike (all response if theirs is the largest id); an empty table has no archives;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import shared, storage

MIN_BYTES = 0
#: An archive is closed, and a new one begun, past so many bytes.
ROLL_BYTES = 1 << 30
WARC, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.jsonl", "datapackage.json"
LOCAL, CENTRAL, END, END64, LOCATOR, TRAILER = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
READ_BYTES = 1 << 20


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


# --- ZIP -------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, from start to end of the file."""

    def __init__(self, file):
        self.file, self.at, self.members, self.open = file, 0, [], None

    def put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]  # name, header's offset, crc, size
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)  # ZIP64: the trailer's sizes have 8 bytes
        self.put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> None:
        self.open[2] = zlib.crc32(data, self.open[2])
        self.open[3] += len(data)
        self.put(data)

    def end(self) -> None:
        _, _, crc, size = self.open
        self.put(struct.pack("<4sIQQ", TRAILER, crc, size, size))
        self.members.append(self.open)

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self.put(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
        size, n, here = self.at - start, len(self.members), self.at
        self.put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self.put(struct.pack("<4sIQI", LOCATOR, 0, here, 1))
        self.put(struct.pack("<4sHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        self.file.close()


class Member(NamedTuple):
    method: int
    crc: int
    size: int
    header: int


class ZipReader:
    """The members of a ZIP file, by its central directory; plain and ZIP64."""

    def __init__(self, source):
        self.source = source
        tail_size = min(source.size, 22 + FULL16 + 20)
        tail = bytes(source.read(source.size - tail_size, tail_size))
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)  # the signature may stand in a comment
        if at < 0:
            raise ValueError("no end of central directory")
        n, size, start = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == LOCATOR:
            (where,) = struct.unpack_from("<Q", tail, at - 12)
            sig, *_, n, size, start = struct.unpack("<4sQHHIIQQQQ", source.read(where, 56))
            if sig != END64:
                raise ValueError("no ZIP64 end of central directory where its locator points")
        self.members: dict[str, Member] = {}
        directory, at = bytes(source.read(start, size)), 0
        for _ in range(n):
            sig, _, _, _, method, _, _, crc, packed, plain, n_name, n_extra, n_comment, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, at)
            if sig != CENTRAL:
                raise ValueError("central directory is damaged")
            name = directory[at + 46 : at + 46 + n_name].decode()
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            plain, packed, header = self._wide(extra, plain, packed, header)
            if packed != plain and method == 0:
                raise ValueError(f"{name}: sizes of a stored member differ")
            self.members[name] = Member(method, crc, packed, header)
            at += 46 + n_name + n_extra + n_comment

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values of all ones stand, in this order, in the ZIP64 field."""
        at, out = 0, list(values)
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                field, used = extra[at + 4 : at + 4 + size], 0
                for k, v in enumerate(out):
                    if v == FULL32:
                        (out[k],) = struct.unpack_from("<Q", field, used)
                        used += 8
            at += 4 + size
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many they are."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed")
        head = self.source.read(m.header, 30)
        if bytes(head[:4]) != LOCAL:
            raise ValueError(f"{name}: no local header where the directory points")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n_name + n_extra, m.size


# --- WARC ------------------------------------------------------------------------------------------


def record_uri(i: int | None) -> str:
    return f"<urn:page:{'null' if i is None else i}>"


def uri_record(uri: str) -> int | None:
    x = uri.strip("<>").rsplit(":", 1)[1]
    return None if x == "null" else int(x)


def record(i: int | None, payload: bytes, sha1: bytes, refers: int | None, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_uri(i)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: urn:page:{'null' if i is None else i}",
        f"WARC-Payload-Digest: sha1:{digest32(sha1)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """A record's header, its payload's full length, and the payload (None for a revisit); digests are verified."""
    if not raw.startswith(b"WARC/1.") or not raw.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[:-4]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record's block has another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(headers(http)["content-length"])
    if fields["warc-type"] == "revisit":
        return fields, length, None
    if len(payload) != length or fields["warc-payload-digest"] != "sha1:" + digest32(hashlib.sha1(payload).digest()):
        raise ValueError(f"{fields['warc-record-id']}: payload doesn't match its digest")
    return fields, length, payload


class ArchiveWriter:
    def __init__(self, folder: str):
        self.path, self.index, self.offset = f"{folder}/{uuid.uuid4().hex}.wacz", [], 0
        self.zip = ZipWriter(storage.writer(self.path))
        self.zip.begin(WARC)

    def add(self, i: int | None, data: bytes) -> None:
        packed = gzip.compress(data, 5, mtime=0)
        self.index.append(f'{{"id": {"null" if i is None else i}, "offset": {self.offset}, "length": {len(packed)}}}\n')
        self.offset += len(packed)
        self.zip.add(packed)

    def close(self) -> tuple[str, int]:
        self.zip.end()
        self.zip.begin(INDEX)
        for a in range(0, len(self.index), 10_000):
            self.zip.add("".join(self.index[a : a + 10_000]).encode())
        self.zip.end()
        self.zip.begin(PACKAGE)
        self.zip.add(json.dumps({"profile": "data-package", "resources": [{"path": WARC}, {"path": INDEX}], "records": len(self.index)}).encode())
        self.zip.end()
        self.zip.close()
        return self.path, len(self.index)


def archive_records(path: str) -> Iterator[bytes]:
    """The records of an archive, by its index; neighbours are read together, READ_BYTES at a time."""
    source = storage.Ranges(path)
    members = ZipReader(source)
    start, size = members.locate(WARC)
    at, length = members.locate(INDEX)
    group: list[tuple[int, int]] = []

    def fetch() -> Iterator[bytes]:
        low = group[0][0]
        data = source.read(start + low, group[-1][0] + group[-1][1] - low)
        for offset, n in group:
            yield gzip.decompress(data[offset - low : offset - low + n])
        group.clear()

    for line in _lines(source, at, length):
        x = json.loads(line)
        if x["offset"] + x["length"] > size:
            raise ValueError("the index points past its member")
        if group and (x["offset"] != sum(group[-1]) or x["offset"] + x["length"] - group[0][0] > READ_BYTES):
            yield from fetch()
        group.append((x["offset"], x["length"]))
    if group:
        yield from fetch()


def _lines(source, at: int, length: int) -> Iterator[bytes]:
    rest = b""
    for a in range(at, at + length, READ_BYTES):
        *lines, rest = (rest + bytes(source.read(a, min(READ_BYTES, at + length - a)))).split(b"\n")
        yield from lines
    if rest:
        yield rest


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, roll_bytes: int = ROLL_BYTES, id_col: str = "page_id", payload_col: str = "html") -> list[str]:
    """Writes the archives; the paths of those that finished tasks report."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(shared.id_or_lowest(id_col).alias("i"), F.unhex(F.sha1(body)).alias("sha"), body.alias("t"))
    small = shared.cut(shared.compact(rows.where(F.length("t") >= min_bytes).select("i", "sha")), "digests")
    repeated = small.groupBy("sha").agg(F.max("i").alias("keeper"), F.count("*").alias("c")).where("c > 1").select("sha", "keeper")
    known = small.join(repeated, "sha").where("i < keeper").distinct()
    full = rows.join(known, ["i", "sha"], "left").select("i", "sha", "t", "keeper")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for part in shared.slices(batches, "t"):
            for i, sha, t, keeper in zip(*(part.column(c).to_pylist() for c in ("i", "sha", "t", "keeper")), strict=True):
                out = out or ArchiveWriter(folder)
                own = None if i == shared.NULL_ID else i
                out.add(own, record(own, t, sha, keeper, keeper is not None))
                if out.offset >= roll_bytes:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "n": [n for _, n in done]})

    return sorted(r.path for r in full.mapInArrow(each, "path string, n long").collect())


def read(spark: SparkSession, paths: list[str], payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if wanted (null for revisits)."""
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payload else "")
    names = [x.split()[0] for x in kind.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                for raw in archive_records(path):
                    f, length, body = parse(raw)
                    revisit = f["warc-type"] == "revisit"
                    row = (uri_record(f["warc-record-id"]), length, f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], uri_record(f["warc-refers-to"]) if revisit else None)
                    rows.append((*row, body) if payload else row)
                    held += len(body or b"") if payload else 100
                    if held >= shared.SLICE_BYTES:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    table = spark.createDataFrame([(p,) for p in paths], "path string")
    return table.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(each, kind)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
