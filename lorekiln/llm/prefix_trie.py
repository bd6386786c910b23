"""The trie of conversation prefixes, by prefix doubling: who shares which first turns, and what storing them once saves.

A rebuilt conversation is the first h turns of conversation c - c % 5 and then its own from its h-th on. Each turn gets a dense name (0, 1, ...), equal turns
the same. Round k names the aligned blocks of 2^k turns by the names of their halves, so there are as many rounds as the longest conversation has binary digits. A prefix of
d turns is put together from the blocks of d's binary digits, highest first, and each partial sum is named as it is met: again logarithmic rounds, and
two rows a turn in all. A node is a name of a prefix. Sums over subtrees double as well: a node that holds the sums of the
descendants less than 2^k below it adds those of the nodes exactly 2^k below, and the ancestor 2^k above a node is the prefix of its smallest member that is
2^k turns shorter. No conversation, node or subtree is ever gathered in one row or task: turns get their ranks from range partitions, equal keys are
aggregated before they are shuffled, joins have one row a key on one side, and the ids that end at a node stream past in pieces of bounded size. SHA-256 alone is sequential:
the pieces of one node pass through one task, some ten bytes a conversation.

Texts don't move: a turn is told apart by the SHA-256 of role and text, the role's length in front. Every round is a table in the shared folder, since numbers of
rows must not change when an executor is lost.

Defined cases: null roles and texts are empty; turns in order of number, null first, then role, then digest; repeated rows are as many turns; rows without a conv_id
belong to no conversation and are left out, so a table without a conv_id has no nodes, not even a root; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import shared

#: Conversations in a row share the first turns of the smallest of them; fewer than LONGEST of these.
FAMILY, LONGEST = 5, 9
#: Ids of a node that a row carries at most, on their way to its digest.
PIECE_IDS = 1 << 15


def numbered(df: DataFrame, name: str, tag: str, start: int = 0) -> tuple[DataFrame, int, DataFrame]:
    """df with the numbers start, start + 1, ... in the order of its partitions and their rows; the next number; the table below, to be dropped.

    Written first, since row numbers of a plan aren't the same twice. The driver gets one row a partition, and that many are broadcast.
    """
    table = shared.cut(df.withColumn("at", F.monotonically_increasing_id()), tag)
    counts = sorted(table.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    bases, total = [], start
    for part, n in counts:
        bases.append((part, total - (part << 33)))
        total += n
    bases = df.sparkSession.createDataFrame(bases, "part long, base long")
    rows = table.join(F.broadcast(bases), F.shiftright("at", 33) == F.col("part")).withColumn(name, F.col("at") + F.col("base"))
    return rows.drop("at", "part", "base"), total, table


def _named(rows: DataFrame, keys: list[str], name: str, tag: str, start: int = 0, aggregates=()) -> tuple[DataFrame, DataFrame, int]:
    """rows (a table) with a dense name of their keys, as a table; the names with their keys and aggregates; the next name."""
    names, end, table = numbered(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_convs"), *aggregates), name, f"{tag}-names", start)
    if not aggregates:
        out = shared.cut(rows.join(names.drop("n_convs"), keys).drop(*keys), tag)
        shared.drop(table)
        return out, names, end
    return shared.cut(rows.join(names.select(*keys, name), keys), tag), names, end


def rebuilt(conversations: DataFrame, family: int = FAMILY, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Turns (c, i, turn, bytes) of the rebuilt conversations, i from 0 without a gap, and (c, length) of all of them; both are tables."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turn = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("o"), role.alias("r"), turn.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["c", F.col("o").asc_nulls_first(), "r", "turn"]
    rows, _, table = numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("o", "r"), "g", "trie-turns")
    convs = rows.groupBy("c").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("own"))
    convs = convs.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % longest).withColumn("b", F.col("c") - F.col("c") % family)
    convs = shared.cut(convs, "trie-convs")
    base = convs.select(F.col("c").alias("b"), F.col("own").alias("base_own"))
    convs_b = shared.cut(convs.join(base, "b", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0)))), "trie-convs-b")
    ranked = shared.cut(rows.join(convs_b.select("c", "first", "h", "taken"), "c").withColumn("k", F.col("g") - F.col("first")), "trie-ranked")
    own = ranked.where("k >= h").select("c", (F.col("k") - F.col("h") + F.col("taken")).alias("i"), "turn", "bytes")
    heads = ranked.where(F.col("k") < longest - 1).select(F.col("c").alias("b"), F.col("k").alias("i"), "turn", "bytes")
    lent = heads.join(convs_b.select("c", "b", "h"), "b").where("i < h").select("c", "i", "turn", "bytes")
    turns = shared.cut(own.unionByName(lent), "trie-rebuilt")
    lengths = shared.cut(convs_b.select("c", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "trie-lengths")
    shared.drop(table, convs, convs_b, ranked)
    return turns, lengths


def _blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each k, (c, j, name) of the aligned blocks of 2^k turns, j the block's number in its conversation."""
    level, _, _ = _named(turns.select("c", F.col("i").alias("j"), "turn"), ["turn"], "name", "trie-block-0")
    out = [level]
    while 2 << (len(out) - 1) <= longest:
        half = F.col("j") % 2
        pairs = out[-1].groupBy("c", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        pairs = shared.cut(pairs.where("right IS NOT NULL"), f"trie-pairs-{len(out)}")
        level, _, _ = _named(pairs, ["left", "right"], "name", f"trie-block-{len(out)}")
        shared.drop(pairs)
        out.append(level)
    return out


def _prefixes(blocks: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(c, d, node) of every prefix of d >= 1 turns of every conversation, and (node, depth, n_convs, conv_id) of the nodes below the root."""
    made, nodes, start = None, None, 1
    for k in reversed(range(len(blocks))):
        step = blocks[k].where("j % 2 = 0").select("c", (F.col("j") * (1 << k)).alias("o"), F.col("name").alias("block"))
        if made is not None:
            before = made.select("c", F.col("d").alias("o"), F.col("node").alias("before"))
            step = step.join(before, ["c", "o"], "left")
        else:
            step = step.withColumn("before", F.lit(None).cast("long"))
        step = shared.cut(step.select("c", (F.col("o") + (1 << k)).alias("d"), F.coalesce("before", F.lit(0)).alias("before"), "block"), f"trie-step-{k}")
        rows, names, start = _named(step, ["d", "before", "block"], "node", f"trie-prefix-{k}", start, [F.min("c").alias("conv_id")])
        rows, names = rows.select("c", "d", "node"), names.select("node", F.col("d").alias("depth"), "n_convs", "conv_id")
        shared.drop(step, blocks[k])
        made, nodes = (rows, names) if made is None else (made.unionByName(rows), nodes.unionByName(names))
    return made, nodes


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the sorted ids c of each node. A node's ids may lie in several partitions; runs that touch an edge, or are long, leave in pieces."""
    order = ["node", "c"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, first, whole, out = None, [], None, False, []

        def leave(is_whole: bool) -> None:
            text = ",".join(map(str, ids))
            out.append((node, first, hashlib.sha256(text.encode()).hexdigest() if is_whole else text, is_whole))

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], ["node", "first", "said", "whole"])
            out.clear()
            return batch

        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if n != node or len(ids) == PIECE_IDS:
                    if ids:
                        leave(whole and n != node)
                    whole = node is not None and n != node  # the first run of a partition may go on before it, and no piece is a whole run
                    node, ids, first = n, [], c
                ids.append(c)
            if out:
                yield flushed()
        if ids:
            leave(False)
            yield flushed()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, digests = [], []
            for n, text in zip(batch.column("node").to_pylist(), batch.column("said").to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = n, hashlib.sha256(text.encode())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(digests)], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    found = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, "node long, first long, said string, whole boolean")
    found = shared.cut(found, "trie-ends")
    pieces = found.where("NOT whole").select("node", "first", "said").repartition("node").sortWithinPartitions("node", "first").select("node", "said")
    return found.where("whole").select("node", F.col("said").alias("ends_sha256")).unionByName(pieces.mapInArrow(joined, "node long, ends_sha256 string"))


def trie(conversations: DataFrame, family: int = FAMILY, longest: int = LONGEST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    spark = conversations.sparkSession
    turns, lengths = rebuilt(conversations, family, longest)
    n_convs, conv_id, deepest = lengths.agg(F.count(F.lit(1)), F.min("c"), F.max("length")).first()
    root = spark.createDataFrame([(0, 0, n_convs, conv_id)] if n_convs else [], "node long, depth long, n_convs long, conv_id long")
    deepest = deepest or 0
    if deepest:
        prefixes, nodes = _prefixes(_blocks(turns, deepest))
    else:
        prefixes, nodes = spark.createDataFrame([], "c long, d long, node long"), root.limit(0)

    # the ancestors 1, 2, 4 ... above each node, and the bytes of its last text
    up = nodes.select("node", "depth", "n_convs", F.col("conv_id").alias("c"), F.explode(F.expr("transform(sequence(0, 62), k -> shiftleft(1L, k))")).alias("up")).where("up <= depth")
    at = prefixes.select("c", "d", F.col("node").alias("above"))
    up = up.withColumn("d", F.col("depth") - F.col("up")).join(at, ["c", "d"], "left").select("node", "up", F.coalesce("above", F.lit(0)).alias("above"))
    up = shared.cut(up, "trie-above")
    sizes = turns.select("c", (F.col("i") + 1).alias("d"), "bytes")
    known = nodes.withColumnsRenamed({"conv_id": "c", "depth": "d"}).join(sizes, ["c", "d"]).select("node", F.col("d").alias("depth"), "n_convs", F.col("c").alias("conv_id"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    known = known.unionByName(root.withColumn("saved", F.lit(0).cast("long")))
    parents = up.where("up = 1").select("node", F.col("above").alias("parent"))
    children = parents.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    known = shared.cut(known.join(parents, "node", "left").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    # sums over the descendants less than 1, 2, 4 ... below
    sums = known.select("node", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    step = 1
    while step <= deepest:
        lifted = sums.join(up.where(F.col("up") == step), "node").select(F.col("above").alias("node"), "n_leaves", "saved_tokens")
        grown = shared.cut(sums.unionByName(lifted).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), f"trie-sums-{step}")
        if step > 1:
            shared.drop(sums)
        sums, step = grown, 2 * step

    last = lengths.where("length > 0").withColumnRenamed("length", "d").join(prefixes, ["c", "d"]).select("node", "c")
    ends = _digests(last.unionByName(lengths.where("length = 0").select(F.lit(0).cast("long").alias("node"), "c")))
    out = known.join(sums, "node").join(ends, "node", "left")
    parent = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parent, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
