"""Token ids as flat binary files with 64-bit document offsets.

A table of documents becomes parts: a .bin file of little-endian unsigned ids (2 bytes wide if the
vocabulary fits, else 4) and an .idx file with a header, the documents' ids and their n + 1 offsets, all 64-bit.
Documents are range-partitioned and sorted by id, so a part is a run of the whole order; a part's
writer knows only its own offsets, and the base of each part is the sum of the ids in the parts before it. The order
of the parts is that of their first keys, not of task numbers. Files have names of their own for
each attempt, and only those that a finished task reports are read; a lost executor repeats its part.

Readers map the files and take a document by its offsets, without reading what lies before.

Defined cases: null and empty texts are documents of the end id alone; a null id comes before all
others; rows of one id stand in the order of their texts' hashes; repeated rows are repeated; an empty
table has no parts; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import shared, storage

MAGIC = b"LKTOKIDX"
HEADER = struct.Struct("<8sIIQQ")  # magic, version, bytes of an id, documents, ids
END_ID = 2
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file as the library loads it, once for each worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


#: Texts with other characters go to the library whole: of these the classes are the same in every Unicode version.
USUAL = r"\t\n\r\x20-\x7E\xA1-\u02FF\u2010-\u2027\u20AC"


def _usual(kind: str) -> str:
    """The usual characters of a general category, for use in a class."""
    span = (chr(c) for c in (*range(0x7F), *range(0xA1, 0x300), *range(0x2010, 0x2028), 0x20AC))
    return "".join(re.escape(c) for c in span if unicodedata.category(c)[0] == kind)


def pieces() -> str:
    """The pieces that a byte-level pre-tokenizer makes of a usual text, each of which is merged by itself."""
    letters, numbers = _usual("L"), _usual("N")
    return rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"


#: Pieces that a worker keeps; past that it forgets all and begins anew, which changes no result.
MEMO_PIECES = 1_000_000
#: New pieces that go to the library together.
TOGETHER = 512


class Encoder:
    """Encodes texts. A piece that a worker has met isn't encoded again, if the tokenizer is of the kind that merges pieces by themselves."""

    def __init__(self, path: str, end_id: int | None):
        import json

        self.made = tokenizer(path)
        top = max(self.made.get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
        self.width = 2 if top < 1 << 16 else 4
        form = json.loads(self.made.to_str())
        added = [x["content"] for x in form.get("added_tokens", [])]
        cut, model = form.get("pre_tokenizer") or {}, form["model"]
        plain = not form.get("normalizer") and not form.get("truncation") and not form.get("padding") and not model.get("dropout") and not any(re.search(r"\s", x) for x in added)
        self.by_pieces = plain and model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        # texts with an added token's string go to the library whole as well: it is cut out before all else
        self.split, self.unusual = re.compile(pieces()).findall, re.compile(f"[^{USUAL}]").search
        self.added = added
        self.memo: dict[str, bytes] = {}
        self.between = self.made.encode("\n", add_special_tokens=False).ids if self.by_pieces else []
        self.by_pieces = len(self.between) == 1

    def _raw(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, ids)]) * self.width
        flat = np.fromiter(chain.from_iterable(ids), f"<u{self.width}").tobytes()
        return [flat[a:b] for a, b in pairwise(ends.tolist())]

    def _learn(self, new: set[str]) -> None:
        """Takes pieces into the memo. Those that aren't white space are encoded many together: a line end before one is a piece, and an id, of its own."""
        white = [p for p in new if p.isspace()]
        self.memo.update(zip(white, self._raw(white), strict=True))
        solid = list(new.difference(white))
        for k in range(0, len(solid), TOGETHER):
            some = solid[k : k + TOGETHER]
            ids = np.array(self.made.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            at = np.flatnonzero(ids == self.between[0])
            flat, first, last = ids.tobytes(), [0, *((at + 1) * self.width).tolist()], [*(at * self.width).tolist(), None]
            self.memo.update(zip(some, [flat[a:b] for a, b in zip(first, last, strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as they are stored."""
        if not self.by_pieces:
            return self._raw(texts)
        out = [None if self.unusual(t) or any(x in t for x in self.added) else self.split(t) for t in texts]
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        self._learn(set().union(*[x for x in out if x]).difference(self.memo))
        whole = [k for k, x in enumerate(out) if x is None]
        known = self.memo.__getitem__
        out = [x if x is None else b"".join(map(known, x)) for x in out]
        for k, raw in zip(whole, self._raw([texts[k] for k in whole]), strict=True):
            out[k] = raw
        return out


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


class PartWriter:
    def __init__(self, folder: str, width: int):
        self.stem, self.width = f"{folder}/{uuid.uuid4().hex}", width
        self.file = storage.writer(self.stem + ".bin")
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, raw: bytes) -> None:
        self.file.write(raw)
        self.ids.append(doc_ids.astype("<i8"))
        self.lengths.append(lengths.astype(np.uint64))

    def close(self) -> tuple[int, int]:
        self.file.close()
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        offsets = np.zeros(len(ids) + 1, "<u8")
        np.cumsum(lengths, out=offsets[1:])
        with storage.writer(self.stem + ".idx") as f:
            f.write(HEADER.pack(MAGIC, 1, self.width, len(ids), int(offsets[-1])) + ids.tobytes() + offsets.tobytes())
        return len(ids), int(offsets[-1])


class Part:
    """One part, mapped."""

    def __init__(self, stem: str):
        index = storage.Ranges(stem + ".idx")
        magic, version, self.width, self.n_docs, self.n_tokens = HEADER.unpack(index.read(0, HEADER.size))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{stem}.idx isn't a token index")
        self.ids = np.frombuffer(index.read(HEADER.size, 8 * self.n_docs), "<i8")
        self.offsets = np.frombuffer(index.read(HEADER.size + 8 * self.n_docs, 8 * self.n_docs + 8), "<u8")
        self.data = storage.Ranges(stem + ".bin")
        if self.data.size != self.n_tokens * self.width:
            raise ValueError(f"{stem}.bin has {self.data.size} bytes for {self.n_tokens} ids")

    def tokens(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return np.frombuffer(self.data.read(a * self.width, (b - a) * self.width), f"<u{self.width}")


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int, int]]:
    """Writes the parts; (stem, base, documents, ids) of each in order. What comes to the driver is one row a part."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(shared.id_or_lowest(id_col).alias("i"), F.xxhash64(text).alias("k"), text.alias("t"))
    rows = rows.repartitionByRange("i", "k").sortWithinPartitions("i", "k")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, out, first = encoder(tokenizer_path, end_id), None, None
        end = np.full(1 if end_id is not None else 0, end_id or 0, f"<u{made.width}").tobytes()
        for part in shared.slices(batches, "t"):
            if out is None:
                out, first = PartWriter(folder, made.width), (part.column("i")[0].as_py(), part.column("k")[0].as_py())
            docs = [raw + end for raw in made.encode(part.column("t").to_pylist())]
            out.add(part.column("i").to_numpy(), np.array([len(x) // made.width for x in docs]), b"".join(docs))
        if out is not None:
            n_docs, n_tokens = out.close()
            yield pa.RecordBatch.from_pydict({"i": [first[0]], "k": [first[1]], "stem": [out.stem], "docs": [n_docs], "tokens": [n_tokens]})

    parts = sorted(rows.mapInArrow(each, "i long, k long, stem string, docs long, tokens long").collect())
    out, base = [], 0
    for p in parts:
        out.append((p.stem, base, p.docs, p.tokens))
        base += p.tokens
    return out


def read(spark: SparkSession, parts: list[tuple[str, int, int, int]], tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), and the ids if wanted."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if tokens else "")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, base in zip(b.column("stem").to_pylist(), b.column("base").to_pylist(), strict=True):
                part = Part(stem)
                for a in range(0, part.n_docs, 2048):
                    at = range(a, min(a + 2048, part.n_docs))
                    ids = [part.tokens(k).astype("<u4") for k in at]
                    lengths = part.offsets[a : at[-1] + 2].astype(np.int64)
                    cols = [pa.array([None if x == shared.NULL_ID else x for x in part.ids[a : at[-1] + 1].tolist()], pa.int64()), pa.array(lengths[:-1] + base), pa.array(np.diff(lengths)), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                    if tokens:
                        cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in kind.split(", ")])

    table = spark.createDataFrame([(p[0], p[1]) for p in parts], "stem string, base long")
    return table.repartition(max(1, min(len(parts), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(each, kind)
