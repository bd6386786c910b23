import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lorekiln.llm import ogg


def slow_crc(data):
    x = 0
    for b in data:
        x ^= b << 24
        for _ in range(8):
            x = (x << 1) ^ 0x04C11DB7 if x & 0x80000000 else x << 1
            x &= 0xFFFFFFFF
    return x


def test_checksum():
    rnd = random.Random(1)
    for n in (0, 1, 5, 300):
        data = rnd.randbytes(n)
        assert ogg.crc(data) == slow_crc(data)


@pytest.mark.parametrize("sizes", [[0], [1], [254], [255], [256], [510, 0, 255], [65025], [65024, 3], [65280, 1], [200_000], [255 * 255, 255, 7], []])
def test_packets_survive_lacing(sizes):
    rnd = random.Random(2)
    packets = [rnd.randbytes(n) for n in sizes]
    granules = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    mine = list(ogg.stream_pages(packets, granules, 7, b"head"))
    other = list(ogg.stream_pages([b"x" * 300], [9], 8, b"other"))
    data = b"".join([mine[0], other[0], *mine[1:-1], other[1], mine[-1]])
    out = ogg.demultiplex(data)
    assert set(out) == {7, 8}
    assert out[7].packets == [b"head", *packets] and out[8].packets == [b"other", b"x" * 300]
    if sizes:
        assert out[7].granules[-1] == granules[-1]
    assert all(p.granule == -1 for p in ogg.pages(data) if p.lacing and min(p.lacing) == 255)


def test_damage_is_found():
    good = ogg.mux(b"some text " * 20_000)
    assert ogg.demux(good).payload.rstrip(b"\0") == b"some text " * 20_000
    pages = [x for x in good.split(b"OggS")[1:]]
    join = lambda ps: b"".join(b"OggS" + p for p in ps)
    broken = bytearray(good)
    broken[len(good) // 2] ^= 1
    for bad in (bytes(broken), good[:-1], good[:100], join(pages[:3] + pages[4:]), join(pages[:2] + pages[3:4] + pages[2:3] + pages[4:]), join(pages[:-1]), b"x" + good, b""):
        with pytest.raises(ogg.OggError):
            ogg.demux(bad)


def test_query_columns(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long " * 60_000]
    df = spark.createDataFrame([(k if k else None, t, "b", "m") for k, t in enumerate(texts)] + [(2, "a", "b", "m")], "doc_id long, text string, body string, Media string").withColumn("feature", F.lit(1))
    media = ogg.with_media(df, ["doc_id", "body", "Media", "feature"])
    out = ogg.demuxed(media, ["doc_id", "body", "Media", "feature"], payload=True)
    assert out.columns[:3] == ["doc_id", "body", "n_bytes"]
    out = out.collect()
    assert len(out) == 8
    for r in out:
        raw = (texts[r.doc_id or 0] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert bytes(r.payload) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        x = [b - 128 for b in payload]
        told = (len(x) / 8000, sum(x) / len(x), (sum(y * y for y in x) / len(x)) ** 0.5, sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])))
        assert r.feature == "seconds=%.4f;mean=%.6f;rms=%.6f;crossings=%d" % told
    assert len({r.media_sha256 for r in out if r.doc_id == 2}) == 1
    assert ogg.demuxed(ogg.with_media(df.limit(0), ["doc_id"]), ["doc_id"]).count() == 0
