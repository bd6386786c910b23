"""Ogg media columns: pages with checksums, packets in lacing values, multiplexed logical streams, granule positions.

`with_media` stores bytes as 8-bit samples in an Ogg file in a binary column: a sample stream
(packets of PACKET samples; a granule position counts the samples that are complete at the end of the
page's last finished packet) and a note stream (the unpadded length), their pages interleaved. `demuxed` reads
such a column: it checks each page's checksum and sequence number, sorts pages by serial number, joins
packets over page ends from the lacing values, and takes timestamps from the granule positions.

A file depends on its bytes alone. Each row is worked on by itself, a bounded slice at a time, so
nothing is shuffled and memory is that of the largest row.

Defined cases: null and empty texts are 64 bytes 0; null ids, repeated rows and other columns are
carried; an empty table gives an empty result; a damaged file raises OggError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import shared

UNIT = 64
RATE = 8000
PACKET = 4096
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_SAMPLES, _NOTES = b"\x01PCM8\x00\x00\x00", b"\x01NOTE\x00\x00\x00"


class OggError(ValueError):
    pass


def crc(data: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7, most significant bit first, from 0. It is zlib's with all bits reversed."""
    x = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


class Page(NamedTuple):
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: memoryview


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    def whole(check: int) -> bytes:
        return _HEAD.pack(b"OggS", 0, flags, granule, serial, number, check, len(lacing)) + lacing + body

    return whole(crc(whole(0)))


def stream_pages(packets: list[bytes], granules: list[int], serial: int, head: bytes) -> Iterator[bytes]:
    """The pages of a logical stream: its head alone, then its packets in as few pages as hold 255 lacing values."""
    yield page(FIRST, 0, serial, 0, bytes([len(head)]), head)
    values, ends = bytearray(), []  # ends: number of lacing values at which each packet ends
    for p in packets:
        values += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        ends.append(len(values))
    data, at, number, done, open_packet = b"".join(packets), 0, 1, 0, False
    for a in range(0, max(len(values), 1), 255):
        lacing = bytes(values[a : a + 255])
        body = data[at : at + sum(lacing)]
        at += len(body)
        before = done
        while done < len(ends) and ends[done] <= a + len(lacing):
            done += 1
        granule = granules[done - 1] if done > before else -1
        flags = (CONTINUED if open_packet else 0) | (LAST if a + 255 >= len(values) else 0)
        yield page(flags, granule if packets else 0, serial, number, lacing, body)
        open_packet, number = bool(lacing) and lacing[-1] == 255, number + 1


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a physical stream, checksums verified."""
    view, at = memoryview(data), 0
    while at < len(data):
        if at + 27 > len(data):
            raise OggError("a page is cut off")
        magic, version, flags, granule, serial, number, check, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("a page is cut off")
        if crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != check:
            raise OggError(f"page {number} of stream {serial}: wrong checksum")
        yield Page(flags, granule, serial, number, lacing, view[at + 27 + n : end])
        at = end


class Stream(NamedTuple):
    packets: list[bytes]
    #: Granule position of the page on which each packet ends, if it is the last to end there; else -1.
    granules: list[int]


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Packets of each logical stream by serial number."""
    out: dict[int, Stream] = {}
    parts: dict[int, list] = {}
    state: dict[int, list[int]] = {}  # next page number, whether the stream has ended
    for p in pages(data):
        if p.serial not in out:
            if not p.flags & FIRST:
                raise OggError(f"stream {p.serial} begins without its first page")
            out[p.serial], parts[p.serial], state[p.serial] = Stream([], []), [], [p.number, 0]
        if state[p.serial] != [p.number, 0]:
            raise OggError(f"stream {p.serial}: page {p.number} comes out of turn")
        if bool(p.flags & CONTINUED) != bool(parts[p.serial]):
            raise OggError(f"stream {p.serial}: a packet isn't continued")
        state[p.serial] = [p.number + 1, p.flags & LAST]
        at = start = 0
        ended = 0
        for k, n in enumerate(p.lacing):
            at += n
            if n < 255:
                out[p.serial].packets.append(b"".join([*parts[p.serial], p.body[start:at]]))
                out[p.serial].granules.append(-1)
                parts[p.serial], start, ended = [], at, ended + 1
            elif k == len(p.lacing) - 1:
                parts[p.serial].append(bytes(p.body[start:at]))
        if ended:
            out[p.serial].granules[-1] = p.granule
        elif p.lacing and p.granule != -1:
            raise OggError(f"stream {p.serial}: a granule position without a finished packet")
    for serial, (_, ended) in state.items():
        if not ended or parts[serial]:
            raise OggError(f"stream {serial} is cut off")
    return out


def padded(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def mux(text: bytes) -> bytes:
    payload = padded(text)
    serial = zlib.crc32(payload)
    packets = [payload[a : a + PACKET] for a in range(0, len(payload), PACKET)]
    granules = [min(a + PACKET, len(payload)) for a in range(0, len(payload), PACKET)]
    first = list(stream_pages(packets, granules, serial, _SAMPLES + struct.pack("<II", RATE, 8)))
    second = list(stream_pages([struct.pack("<Q", len(text))], [len(payload)], serial ^ 1, _NOTES))
    return b"".join([first[0], second[0], *first[1:-1], second[1], first[-1]])


class Sound(NamedTuple):
    payload: bytes
    n_bytes: int
    #: Seconds at which each packet ends, where a granule position tells.
    times: list[float]


def demux(data: bytes) -> Sound:
    sounds = notes = None
    for stream in demultiplex(data).values():
        if stream.packets[0].startswith(_SAMPLES):
            sounds = stream
        elif stream.packets[0].startswith(_NOTES):
            notes = stream
    if sounds is None or notes is None:
        raise OggError("a stream is missing")
    rate, bits = struct.unpack_from("<II", sounds.packets[0], len(_SAMPLES))
    if bits != 8:
        raise OggError(f"samples of {bits} bits")
    payload = b"".join(sounds.packets[1:])
    done = 0
    for p, g in zip(sounds.packets[1:], sounds.granules[1:], strict=True):
        done += len(p)
        if g not in (-1, done):
            raise OggError(f"granule position {g} after {done} samples")
    (n_bytes,) = struct.unpack("<Q", notes.packets[1])
    return Sound(payload, n_bytes, [g / rate for g in sounds.granules[1:] if g >= 0])


def features(sound: Sound) -> str:
    """Seconds, mean, root mean square and crossings of the middle, of samples centred at 0."""
    x = np.frombuffer(sound.payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"seconds={sound.times[-1]:.4f};mean={int(x.sum()) / len(x):.6f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.6f};crossings={crossings}"


def with_media(docs: DataFrame, columns: list[str], text_col: str = "text", media_col: str = "media") -> DataFrame:
    """The named columns of docs, and their text as an Ogg file. A named column called like the file's isn't carried."""
    columns = [c for c in columns if c.lower() != media_col.lower()]
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in columns), StructField(media_col, BinaryType())])
    (body,) = shared.fresh([*columns, media_col], "body")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, body):
            data, offsets = shared.text_bytes(part.column(body))
            whole = data.tobytes()
            made = [mux(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(made, pa.binary())], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").cast("string").alias(body)).mapInArrow(each, schema)


READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def demuxed(media: DataFrame, columns: list[str], media_col: str = "media", payload: bool = False) -> DataFrame:
    """The named columns, what READ says of each row's file, and its payload if wanted. Named columns called like one of these, or like the file's, aren't carried."""
    taken = {x.split()[0] for x in READ.split(", ")} | {media_col.lower(), *(["payload"] if payload else [])}
    columns = [c for c in columns if c.lower() not in taken]
    from pyspark.sql.types import StructType

    schema = StructType([*(media.schema[c] for c in columns), *StructType.fromDDL(READ + (", payload binary" if payload else "")).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, media_col):
            rows = []
            for data in part.column(media_col).to_pylist():
                s = demux(data)
                row = (s.n_bytes, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(s))
                rows.append((*row, s.payload) if payload else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False))], names=schema.names)

    return media.mapInArrow(each, schema)
