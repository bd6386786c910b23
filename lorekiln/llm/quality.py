"""Quality rules: surface counts, and the length-normalised log-likelihood ratio of hashed n-grams.

Two multinomials over BUCKETS hashed word 1- and 2-grams are estimated, in which a text counts once however many
copies it has: *raw* from the whole corpus, *target* from the trusted labelled rows (quality 1, not toxic; at most TRUSTED_ROWS of them,
those of the smallest id hash, so the set that travels to the executors is bounded). A document's score is
the mean over its n-grams of log p_target - log p_raw; it is kept if no surface rule fails and the
score reaches THRESHOLD. Both models are taken at the target's size and smoothed by the same number of counts
a bucket, so a bucket of which the target would hold few n-grams says little: clean documents outside
the trusted set don't suffer from their rare words, however small that set is. Nothing is drawn at random: equal input, equal verdict.

The first pass counts texts where they are scanned; only texts that have copies are moved, to be folded, and a scan before it tells which by their hashes. The second
pass is one scan. The histograms are added up by bucket, so what is gathered is
BUCKETS rows at any input size.

Defined cases: a null or empty text has no words, so it fails the surface rule; a null id is carried
through and never trusted; repeated rows are judged each, and counted once for each text; without trusted rows there
is no target, and only the surface rules decide; other columns are ignored, or carried by `judge`.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import shared, textnp

BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
#: Mean log-likelihood ratio in nats for an n-gram.
THRESHOLD = -0.12
#: Counts added to each bucket of both models.
SMOOTHING = 8.0
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
JUDGED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def word_parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and document of the words, a block at a time."""
    for part, own, first in textnp.blocks(data, offsets):
        word, doc = textnp.words(part, own)
        yield word, doc + np.int32(first)


def buckets(parts: Iterable[tuple[np.ndarray, np.ndarray]], n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashed 1- and 2-grams of words that come in parts: bucket and document of each."""
    lead, owner = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    for word, doc in parts:
        pair, first = textnp.grams(np.concatenate([lead, word]), owners := np.concatenate([owner, doc]), 2)
        gram = np.concatenate([word, pair])
        yield (gram % np.uint64(n_buckets)).astype(np.int64), np.concatenate([doc, owners[first]])
        if len(word):
            lead, owner = word[-1:], doc[-1:]


def histograms(docs: DataFrame, trusted: list[int], n_buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, raw, target: n-gram counts over all distinct texts, and over those that a trusted id has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for part in shared.slices(batches, "t"):
            data, offsets = shared.text_bytes(part.column("t"))
            good = part.column("good").to_numpy(zero_copy_only=False)
            for bucket, doc in buckets(word_parts(data, offsets), n_buckets):
                raw += np.bincount(bucket, minlength=n_buckets)
                if good.any():
                    target += np.bincount(bucket[good[doc]], minlength=n_buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    ids = docs.sparkSession.createDataFrame([(int(i), True) for i in sorted(trusted)], "i long, good boolean")
    text = F.col(text_col).cast("string")
    rows = docs.select(shared.id_or_lowest(id_col).alias("i"), text.alias("t"), F.xxhash64(text).alias("x")).join(F.broadcast(ids), "i", "left")
    # a text that has copies is folded before it is dealt out, so one that makes much of the corpus weighs no more than another; the others, which a filter
    # over the hashes met twice tells, are counted where they are scanned
    twice = docs.select(F.xxhash64(text).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = shared.marked(rows, shared.filter_words(shared.cut(twice.select("x"), "copied-texts"), "x"), "x", "may")
    good = F.coalesce("good", F.lit(False))
    folded = rows.where("may").groupBy(F.md5("t").alias("h")).agg(F.first("t").alias("t"), F.max(good).alias("good")).drop("h")
    rows = rows.where("NOT may").select("t", good.alias("good")).union(folded)
    parts = rows.mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> list[int]:
    """Ids of at most `most` trusted labelled rows, the same at every run."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    rows = good.select(F.col("doc_id").cast("long").alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(most).collect()
    return [r.i for r in rows]


def log_ratios(counts: DataFrame, n_buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray | None:
    """log p_target - log p_raw by bucket; None without a target."""
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    for r in counts.collect():  # n_buckets rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return None
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + smoothing) - np.log(expected + smoothing)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line; long ones are told by a 256-bit hash."""
    seen, count = set(), 0
    for line in io.BytesIO(text):
        line = line.removesuffix(b"\n")
        if line.strip(textnp.WHITE):
            key = line if len(line) <= 64 else blake2b(line, digest_size=32).digest() + b"\n"  # no line ends so
            if key in seen:
                count += 1
            else:
                seen.add(key)
    return count


def measure(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray | None, n_buckets: int) -> dict[str, np.ndarray]:
    """The surface counts and the score of each document of a slice."""
    n = len(offsets) - 1
    out = {c: np.zeros(n, np.int64) for c in ("n_words", "word_chars", "n_symbols")}
    for part, own, first in textnp.blocks(data, offsets):
        rows = slice(first, first + len(own) - 1)
        out["word_chars"][rows] += textnp.per_doc(~textnp.SPACE[part] & ((part & 0xC0) != 0x80), own)
        out["n_symbols"][rows] += textnp.per_doc(_SYMBOL[part], own)
    out["n_dup_lines"] = np.array([duplicate_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
    parts = list(word_parts(data, offsets))
    grams, total = np.zeros(n, np.int64), np.zeros(n)
    for bucket, owner in buckets(parts, n_buckets):
        grams += np.bincount(owner, minlength=n)
        if ratio is not None:
            total += np.bincount(owner, weights=ratio[bucket], minlength=n)
    for _, doc in parts:
        out["n_words"] += np.bincount(doc, minlength=n)
    # words in windows that stand twice or more
    found = list(textnp.windows(iter(parts), WINDOW))
    doc = np.concatenate([d for _, d in parts]) if parts else np.zeros(0, np.int32)
    del parts
    key, owner, at = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, kind) for k, kind in enumerate((np.uint64, np.int32, np.int64)))
    del found
    at = at[textnp.repeated(key, owner)]
    change = np.zeros(len(doc) + 1, np.int8)  # at most WINDOW windows stand over a word
    change[at] += 1
    change[at + WINDOW] -= 1
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(change[:-1], dtype=np.int8) > 0], minlength=n)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["score"] = np.round(total / np.maximum(grams, 1), 9)
    return out


def judge(docs: DataFrame, ratio: np.ndarray | None, threshold: float = THRESHOLD, n_buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """docs with the JUDGED columns after its own; columns of docs with those names give way."""
    from pyspark.sql.types import StructType

    names = {x.name for x in StructType.fromDDL(JUDGED)}
    own = [c for c in docs.columns if c not in names]
    if text_col not in own:
        raise ValueError(f"{text_col} clashes with a result column")
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    schema = StructType(docs.schema.fields + StructType.fromDDL(JUDGED).fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, text_col):
            got = measure(*shared.text_bytes(part.column(text_col)), ratio, n_buckets)
            got["kept"] = ~got["base_failed"] & (got["score"] >= threshold)
            more = [pa.array(got[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=schema.names)

    return docs.mapInArrow(each, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Both passes: docs with the JUDGED columns."""
    ratio = log_ratios(histograms(docs, trusted_ids(labels)))
    return judge(docs, ratio, threshold)
