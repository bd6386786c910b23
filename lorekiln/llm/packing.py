"""Best-fit packing of documents into bins of `capacity` words, under conflicts.

A document longer than a bin is cut into pieces of `capacity` words and a rest. Two pieces of one
duplicate cluster (equal words, whatever their case and spacing) never share a bin, nor do pieces of one document;
a bin holds at most `max_sources` sources. Pieces are placed by falling size into the open bin with the
least room that still takes them: bins stand by residual, each with a bitmap of its sources and one of
its clusters, and the search for the successor goes on from residual to residual until a compatible
bin is found; only then a new bin is opened. Within a residual the bin that came first to it is taken.

Pieces are dealt to shards by a hash of id, cluster, piece and copy; a shard has about SHARD_WORDS
words and therefore a bounded number of pieces, and is packed by itself. A hot source or cluster
is spread over all shards. Searches of one (cluster, source) don't look twice at a bin that refused
it: bins only gain sources and clusters, so a refusal holds while the bin stays at its residual.

Defined cases: a document without words (or null) is one row without a bin; null ids and sources
are values of their own; repeated rows are documents of their own, of one cluster; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import shared
from lorekiln.llm.mixing import n_words

CAPACITY = 2048
MAX_SOURCES = 4
SHARD_WORDS = 1 << 22
#: Words that a piece counts besides its own when shards are sized, so that short ones don't crowd a shard.
PIECE_WORDS = 64
PACKED = "doc_id long, source string, n_words long, piece long, copy long, start long, length long, shard long, bin long, bin_offset long"


class Packer:
    """One shard's bins."""

    def __init__(self, capacity: int, max_sources: int):
        self.capacity, self.max_sources = capacity, max_sources
        self.sources: list[int] = []  # bitmap of each bin
        self.clusters: list[int] = []
        self.residual: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual, in the order of their arrival; -1: gone
        self.slot: list[int] = []
        self.live = [0] * (capacity + 1)
        self.open = 0  # bit r: a bin of residual r is open
        self.refused: dict[tuple[int, int], dict[int, int]] = {}

    def place(self, size: int, source: int, cluster: int) -> int:
        """source, cluster: bits, 0 for none. The bin."""
        seen = self.refused.setdefault((source, cluster), {})
        level = size
        while rest := self.open >> level:
            level += (rest & -rest).bit_length() - 1
            bins = self.at[level]
            for k in range(seen.get(level, 0), len(bins)):
                b = bins[k]
                if b >= 0 and not self.clusters[b] & cluster and (self.sources[b] | source).bit_count() <= self.max_sources:
                    seen[level] = k
                    self._move(b, level, level - size)
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    return b
            seen[level] = len(bins)
            level += 1
        b = len(self.residual)
        self.residual.append(-1)
        self.slot.append(-1)
        self.sources.append(source)
        self.clusters.append(cluster)
        self._enter(b, self.capacity - size)
        return b

    def _move(self, b: int, old: int, new: int) -> None:
        self.at[old][self.slot[b]] = -1
        self.live[old] -= 1
        if not self.live[old]:
            self.open &= ~(1 << old)
        self._enter(b, new)

    def _enter(self, b: int, level: int) -> None:
        self.residual[b] = level
        self.slot[b] = len(self.at[level])
        self.at[level].append(b)
        self.live[level] += 1
        self.open |= 1 << level


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, max_sources: int = MAX_SOURCES) -> tuple[list[int], list[int]]:
    """The bin of each piece and its offset there; the pieces come in the order in which they are placed."""
    from collections import Counter

    many = Counter(clusters)
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in many.items() if n > 1)}  # a cluster met once can't conflict
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    packer, bins, offsets = Packer(capacity, max_sources), [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        b = packer.place(size, source_bit[source], cluster_bit.get(cluster, 0))
        bins.append(b)
        offsets.append(capacity - packer.residual[b] - size)
    return bins, offsets


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each piece of each row of docs, without its text. Equal rows are counted before they are told apart again."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("n_words"), F.md5(plain).alias("cluster"))
    rows = rows.groupBy("doc_id", "source", "n_words", "cluster").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n_words") / capacity) - 1, F.lit(0).cast("long")))))
    rows = rows.withColumn("start", F.col("piece") * capacity)
    return rows.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("n_words") - F.col("start"))).drop("copies")


def packed(docs: DataFrame, capacity: int = CAPACITY, max_sources: int = MAX_SOURCES, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """PACKED: where each piece of each document lies."""
    rows = shared.cut(pieces(docs, capacity, id_col, source_col, text_col), "pieces")
    full = rows.where("length > 0")
    words = full.agg(F.sum(F.col("length") + PIECE_WORDS)).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    full = full.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece", "copy"), F.lit(shards)))

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        bins, offsets = pack_shard(table["length"].to_pylist(), table["source"].to_pylist(), table["cluster"].to_pylist(), capacity, max_sources)
        table = table.drop_columns(["cluster"]).append_column("bin", pa.array(bins, pa.int64())).append_column("bin_offset", pa.array(offsets, pa.int64()))
        return table.select([x.split()[0] for x in PACKED.split(", ")])

    columns = ["doc_id", "source", "n_words", "piece", "copy", "start", "length", "shard", "cluster"]
    done = full.select(*columns).groupBy("shard").applyInArrow(each, PACKED)
    empty = rows.where("length = 0").select("doc_id", "source", "n_words", "piece", "copy", "start", "length", *[F.lit(None).cast("long").alias(c) for c in ("shard", "bin", "bin_offset")])
    return done.unionByName(empty)
