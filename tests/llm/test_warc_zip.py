import base64
import hashlib
import io
import random
import zipfile
from collections import defaultdict

import pytest

from lorekiln.llm import storage, warc_zip


def brute(rows, least=0):
    best = defaultdict(lambda: -(2**63))
    low = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        raw = (t or "").encode()
        best[raw] = max(best[raw], low(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        keep = len(raw) < least or low(i) == best[raw]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if keep else "revisit", None if keep else best[raw]))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    hot = "<p>copy</p>" * 50
    rows = [(k, hot if k % 3 == 0 else f"<html>{'é' * rnd.randint(0, 400)}</html>" if k % 7 else "\r\n\r\nWARC/1.1\r\n\r\n") for k in range(300)]
    rows += [(None, hot), (None, None), (500, ""), (501, None), (299, rows[299][1]), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(*r, "u", 1) for r in rows], "page_id long, html string, url string, keeper int").repartition(6)
    paths = warc_zip.write(df, str(tmp_path / "w"), roll_bytes=2000)
    assert len(paths) > 3
    out = warc_zip.read(spark, paths).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute(rows)
    texts = {(i, len((t or "").encode())): t or "" for i, t in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in out)
    assert all(bytes(r.payload).decode() == texts[r.page_id, r.payload_bytes] for r in out if r.payload is not None)
    few = warc_zip.read(spark, warc_zip.write(df, str(tmp_path / "v"), min_bytes=600), payload=False).collect()
    assert sorted(map(tuple, few), key=str) == brute(rows, 600)
    assert warc_zip.write(df.limit(0), str(tmp_path / "e")) == [] and warc_zip.read(spark, []).count() == 0


def test_archives_are_zip_files_that_others_read(spark, tmp_path):
    (path,) = warc_zip.write(spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, html string").coalesce(1), str(tmp_path))[:1]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert set(z.namelist()) == {warc_zip.WARC, warc_zip.INDEX, warc_zip.PACKAGE}
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


class Bytes:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read(self, offset, length):
        if offset < 0 or offset + length > self.size:
            raise ValueError("range")
        return memoryview(self.data)[offset : offset + length]


def made(**more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("one", b"1" * 10)
        with z.open(zipfile.ZipInfo("two"), "w", force_zip64=True) as f:
            f.write(b"22")
        z.writestr("packed", b"3" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = more.get("comment", b"")
    return out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06" + b"x" * 30, b"c" * 65535])
def test_directories_of_other_writers(comment):
    data = b"before it" * 0 + made(comment=comment)
    z = warc_zip.ZipReader(Bytes(data))
    assert list(z.members) == ["one", "two", "packed"]
    for name, want in (("one", b"1" * 10), ("two", b"22")):
        at, n = z.locate(name)
        assert data[at : at + n] == want
    with pytest.raises(ValueError):
        z.locate("packed")


def test_zip64_directory_with_very_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(66_000):
            z.writestr(f"f{k}", b"")
    assert len(warc_zip.ZipReader(Bytes(out.getvalue())).members) == 66_000


def test_damage_is_found(tmp_path):
    with pytest.raises(ValueError):
        warc_zip.ZipReader(Bytes(b"no zip"))
    raw = warc_zip.record(1, b"abc", hashlib.sha1(b"abc").digest(), None, False)
    assert warc_zip.parse(raw)[2] == b"abc"
    for bad in (raw.replace(b"abc", b"abd"), raw[:-1], b"x" + raw):
        with pytest.raises(ValueError):
            warc_zip.parse(bad)
    (tmp_path / "f").write_bytes(b"12345")
    r = storage.Ranges(f"file://{tmp_path}/f")
    assert bytes(r.read(1, 3)) == b"234"
    with pytest.raises(ValueError):
        r.read(3, 3)
