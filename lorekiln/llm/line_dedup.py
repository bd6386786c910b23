r"""Line dedup: which lines of which documents repeat across the corpus, as compressed bitmaps.

A line's key is the line without the white space at its ends and with A-Z lower-cased. A key of at
least `min_chars` code points that stands in at least `min_docs` documents loses all its lines,
except those in the largest document id that holds it.

One row (128-bit key hash, id, text hash, position) goes out for each long enough line; text doesn't
move. The rows are range-partitioned by (key, id) and sorted by id descending and position, so a
stream over a partition meets the keeper of each key first and knows after `min_docs` ids whether
the rest go. A frequent key is simply spread over several partitions: the range bounds are taken
from key and id together, the run that a partition opens or closes with stays open, and open runs
meet through one (key, number of ids, largest id) row from each partition they touch. At most two
such rows leave a partition, whatever the data. Dropped positions then become one zlib-compressed
bitmap a document (bit 1: keep; lines past its end stay).

Defined cases: null and empty texts are one empty line; a null id is one document and sorts before
all others; rows of one id count as one document, and each of their texts has its own bitmap;
repeated rows share one; empty tables give empty results; other columns are ignored or carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lorekiln.llm import shared

MIN_CHARS, MIN_DOCS = 40, 5
_WHITE = b" \t\n\x0b\x0c\r"
_RUN = "hi long, lo long, i long, v long, p int, kind int, n long"
DROP, OPEN, EDGE = 0, 1, 2


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i: id; v: hash of the text, which tells texts of one id apart; t: text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(shared.id_or_lowest(id_col).alias("i"), F.xxhash64(text).alias("v"), text.alias("t"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """hi, lo, i, v, p: key hash, id, text hash and position of every line with a long enough key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in shared.slices(batches, "t"):
            data, offsets = shared.text_bytes(part.column("t"))
            whole = data.tobytes()
            digest, rows, at = [], [], []
            for row in range(part.num_rows):
                for p, line in enumerate(whole[offsets[row] : offsets[row + 1]].split(b"\n")):
                    if len(line) >= min_chars:
                        key = line.strip(_WHITE).lower()  # bytes.lower() knows A-Z only
                        if len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars:
                            digest.append(xxhash.xxh3_128_digest(key))
                            rows.append(row)
                            at.append(p)
            if rows:
                halves = np.frombuffer(b"".join(digest), np.int64)
                rows = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(halves[0::2]), pa.array(halves[1::2]), part.column("i").take(rows), part.column("v").take(rows), pa.array(at, pa.int32())], ["hi", "lo", "i", "v", "p"])

    return _keyed(docs, id_col, text_col).mapInArrow(each, "hi long, lo long, i long, v long, p int")


def _settle(sorted_rows: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Streams one sorted partition. The first row of a run has the largest id, the keeper.

    DROP: rows known to go. OPEN: rows of the partition's first run, which may go on from the partition
    before, and of a last run with too few ids so far; EDGE: these runs' number of ids and largest id.
    """
    names = ["hi", "lo", "i", "v", "p"]
    key: tuple[int, int] | None = None
    first = True  # the run under way is the partition's first
    ids = keeper = last = 0
    waiting: list[list[np.ndarray]] = []  # rows of the run under way while it has fewer than min_docs ids

    def rows(cols: list[np.ndarray], kind: int, n: int = 0) -> pa.RecordBatch:
        size = len(cols[0])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, n, np.int64))], [*names, "kind", "n"])

    def edge() -> pa.RecordBatch:
        return rows([np.array([x], t) for x, t in ((key[0], "i8"), (key[1], "i8"), (keeper, "i8"), (0, "i8"), (0, "i4"))], EDGE, ids)

    for batch in sorted_rows:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        hi, lo, i = cols[:3]
        begins = np.ones(n, bool)
        begins[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        begins[0] = (int(hi[0]), int(lo[0])) != key
        new_id = begins.copy()
        new_id[1:] |= i[1:] != i[:-1]
        new_id[0] |= i[0] != last
        starts = np.flatnonzero(begins)

        head = int(starts[0]) if len(starts) else n
        pieces = [(0, head)] if head else []
        if len(starts):
            tail = int(starts[-1])
            begin = head
            if key is None and len(starts) > 1:  # the partition's first run, which stays open
                begin = int(starts[1])
                pieces.append((head, begin))
            if begin < tail:  # whole runs inside this batch, decided together
                inner = starts[(starts >= begin) & (starts < tail)]
                ends = np.append(inner[1:], tail)
                total = np.concatenate([[0], np.cumsum(new_id)])
                many = total[ends] - total[inner] >= min_docs
                size = ends - inner
                chosen = np.repeat(many, size) & (i[begin:tail] != np.repeat(i[inner], size))
                if chosen.any():
                    yield rows([c[begin:tail][chosen] for c in cols], DROP)
            pieces.append((tail, n))

        for a, b in pieces:
            if begins[a]:
                if key is not None and first:
                    yield edge()
                    first = False
                key, ids, keeper, waiting = (int(hi[a]), int(lo[a])), 0, int(i[a]), []
            ids += int(new_id[a:b].sum())
            piece = [c[a:b] for c in cols]
            if first:
                yield rows(piece, OPEN)
            elif ids < min_docs:
                waiting.append(piece)
            else:
                for held in [*waiting, piece]:
                    if (go := held[2] != keeper).any():
                        yield rows([c[go] for c in held], DROP)
                waiting = []
        last = int(i[-1])
    if key is not None:
        for held in waiting:
            yield rows(held, OPEN)
        yield edge()


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, v, p: id, text hash and position of every line that goes."""
    keys = shared.cut(shared.compact(line_keys(docs, min_chars, id_col, text_col)), "line-keys")  # range bounds are taken from the table, not from a second scan of the text
    dealt = keys.repartitionByRange(*(F.col(c) for c in ("hi", "lo")), F.col("i").desc()).sortWithinPartitions("hi", "lo", F.col("i").desc(), "v", "p")
    seen = shared.cut(dealt.mapInArrow(lambda rows: _settle(rows, min_docs), _RUN), "line-runs")
    shared.drop(keys)
    # An edge row or two from each partition: their number is that of the partitions, not of the rows.
    edges = seen.where(F.col("kind") == EDGE).groupBy("hi", "lo").agg(F.sum("n").alias("ids"), F.max("i").alias("keeper"))
    edges = edges.where(F.col("ids") >= min_docs)
    opened = seen.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["hi", "lo"]).where(F.col("i") != F.col("keeper"))
    return seen.where(F.col("kind") == DROP).select("i", "v", "p").unionByName(opened.select("i", "v", "p"))


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """A bit for each line up to the byte of the last dropped one; 1: keep."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def dropped_of(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """True at each line that goes."""
    out = np.zeros(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        out[: len(bits)] = bits == 0
    return out


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, v, keep: the keep bitmap of every document that loses a line; no text."""
    drops = dropped_lines(docs, min_chars, min_docs, id_col, text_col)
    lists = drops.groupBy("i", "v").agg(F.array_sort(F.collect_set("p")).alias("p"))  # as long as one document's lines at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pack_bitmap(np.array(x.as_py(), np.int64)) for x in b.column("p")]
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("v"), pa.array(made, pa.binary())], ["i", "v", "keep"])

    return lists.mapInArrow(each, "i long, v long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, columns: list[str], keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The named columns of docs, and `keep`: null for documents that lose nothing.

    A filter of bounded size over (id, text hash) lets go by what surely has no bitmap: those texts don't leave the scan. The others, with few
    in vain until the filter fills up, meet their bitmaps by a hash join: the bitmaps of a partition are hashed and the texts stream past them, so no text is sorted or held.
    """
    i, v, h, may = shared.fresh([*columns, keep], "i", "v", "h", "may")
    bitmaps = shared.cut(bitmaps, "bitmaps")
    words = shared.filter_words(bitmaps.select(F.xxhash64("i", "v").alias("h")), "h")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    left = docs.select(*[F.col(f"`{c}`") for c in columns], shared.id_or_lowest(id_col).alias(i), F.xxhash64(text).alias(v))
    left = shared.marked(left.withColumn(h, F.xxhash64(i, v)), words, h, may)
    right = bitmaps.select(F.col("i").alias(i), F.col("v").alias(v), F.col("keep").alias(keep))
    met = left.where(may).join(right.hint("shuffle_hash"), [i, v], "left").drop(i, v, h, may)
    return left.where(~F.col(may)).drop(i, v, h, may).withColumn(keep, F.lit(None).cast("binary")).union(met)


@F.arrow_udf(StructType([StructField("t", StringType()), StructField("n", LongType())]))
def _kept(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    """The text less its dropped lines, and their number; null without a bitmap."""
    texts, gone = [], []
    for one, bits in zip(text, bitmap, strict=True):
        if not bits.is_valid:
            texts.append(None)
            gone.append(None)
            continue
        split = one.as_py().split("\n")
        go = dropped_of(bits.as_py(), len(split))
        texts.append("\n".join(x for x, g in zip(split, go, strict=True) if not g))
        gone.append(int(go.sum()))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["t", "n"])


def deduped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `text_col` less its dropped lines, and n_lines, n_dropped (long) after its own columns.

    Only texts that lose a line are given to Python; the others go from the scan to the result.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keep, got = shared.fresh([*own, "n_lines", "n_dropped"], "keep", "got")
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs, id_col, text_col), own, keep, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    touched = F.col(keep).isNotNull()
    cut = joined.withColumn(got, _kept(F.when(touched, text), F.col(keep)))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    columns = [F.when(touched, F.col(f"{got}.t")).otherwise(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in own]
    return cut.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.col(f"{got}.n"), F.lit(0).cast("long")).alias("n_dropped"))
