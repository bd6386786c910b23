"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures, confirmed on full sets.

A document's set are its distinct word shingles. Equal sets fold into one class first, so copies are
never joined with each other. A class gets a signature of CHUNKS * WIDTH minhash values, each cut
to 16 bits. By the pigeonhole principle two signatures that differ in at most RADIUS = 2 * CHUNKS - 1
values have a chunk with at most one difference; so each chunk goes out under WIDTH keys, each
leaving out one of its values, and every pair within RADIUS shares a key. (A pair of similarity 0.8,
whose signatures differ in more values, still has a chunk with at most one difference but for a
probability of 1.4e-5, and the fewer differences the less.)

Pairs within a key aren't written out. First each key links its members to one hub; links are confirmed on the full sets, and components are
taken. Then only keys whose members are still in different components are looked at again, in
blocks of BLOCK_BYTES against each other, comparing sets whose hashes are cut to 16 bits. These can only have more in common than
the sets, so no link is lost there; what they let through is confirmed on the full sets. No key, group or
candidate list has a cap.

Defined cases: no words or null text: an empty set, which links with nothing (component: itself);
fewer words than a shingle takes: the whole sequence is the one shingle; a null id can't be
named by others, so it links with nothing, its component is null and it is kept; rows of one id are
one document, linked if any of its texts is; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.llm import shared, textnp
from lorekiln.llm.components import components

CHUNKS, WIDTH = 13, 7
VALUES = CHUNKS * WIDTH
RADIUS = 2 * CHUNKS - 1
#: Differing values up to which a hub's pair is confirmed at once; similarity 0.8 gives 18.2 with a deviation of 3.8, and others are met again.
REACH = 42
#: Bytes of the members of a key, past which they meet in blocks; a set of up to BRIEF_16 items is told by 16 bits an item.
BLOCK_BYTES, BRIEF_16 = 8 << 20, 2048
#: First members of a key, in an order common to all keys, of which one is its hub.
HUBS = 8

_rng = np.random.Generator(np.random.PCG64(977))
_A = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_PLACE = (_rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).reshape(CHUNKS, WIDTH)
_TAG = _rng.integers(1, 2**63, VALUES, dtype=np.uint64).reshape(CHUNKS, WIDTH)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each document of a slice; a long document goes by in blocks."""
    n = len(offsets) - 1
    heads, count = [], np.zeros(n, np.int64)

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, own, first in textnp.blocks(data, offsets):
            word, doc = textnp.words(textnp.LOWER[part], own)
            count[:] += np.bincount(doc + first, minlength=n)
            # the first words of each document, for those with fewer than a shingle takes
            lead = np.flatnonzero(np.diff(doc, prepend=-1))
            some = np.arange(len(doc)) - np.repeat(lead, np.diff(lead, append=len(doc))) < size
            heads.append((word[some], doc[some] + first))
            yield word, doc + np.int32(first)

    found = []
    for key, doc, _ in textnp.windows(parts(), size):
        if n == 1:
            found.append((np.unique(key), None))
        else:
            found.append((key, doc))
    if n == 1:
        sets = [np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.uint64)]
    else:
        key, doc = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, kind) for k, kind in enumerate((np.uint64, np.int32)))
        at = np.searchsorted(doc, np.arange(n + 1))
        sets = [np.unique(key[at[d] : at[d + 1]]) for d in range(n)]
    for d in np.flatnonzero((count > 0) & (count < size)):
        word = np.concatenate([w[of == d] for w, of in heads])
        sets[d] = textnp.grams(word, np.zeros(len(word), np.int32), len(word))[0]
    return sets


def signature(items: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, ~np.uint64(0))
    for a in range(0, len(items), 4096):
        least = np.minimum(least, (items[None, a : a + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    return (textnp.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """VALUES keys for each signature: every chunk with each one of its values left out."""
    parts = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64) * _PLACE
    return textnp.mix(parts.sum(axis=2, keepdims=True) - parts + _TAG).reshape(-1, VALUES)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(shared.id_or_lowest(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, n: size of the set; h1, h2: 128-bit hash of the set; sig."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in shared.slices(batches, "t"):
            sets = shingle_sets(*shared.text_bytes(part.column("t")), shingle)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64)
            sig = [signature(x).tobytes() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest[0::2]), pa.array(digest[1::2]), pa.array(sig, pa.binary())], ["i", "n", "h1", "h2", "sig"])

    return _rows(docs, id_col, text_col).mapInArrow(each, "i long, n long, h1 long, h2 long, sig binary")


def _shared_keys(classes: DataFrame) -> DataFrame:
    """key, node: the keys that more than one class has."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                p = b.slice(at, 1024)
                sig = np.frombuffer(b"".join(p.column("sig").to_pylist()), np.uint16)
                node = np.repeat(p.column("node").to_numpy(), VALUES)
                yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sig).reshape(-1).view(np.int64)), pa.array(node)], ["key", "node"])

    def fellows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves out keys that stand once inside the sorted partition; one at its edge may go on in the next, and stays."""
        before, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            key, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
            if held is not None:
                key, node = np.append(held[0], key), np.append(held[1], node)
            same = np.ones(len(key) + 1, bool)  # the first row has no known neighbour: it stays
            same[1:-1] = key[1:] == key[:-1]
            same[0] = before is None or before == key[0]
            stays = (same[:-1] | same[1:])[:-1]
            if stays.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1][stays]), pa.array(node[:-1][stays])], ["key", "node"])
            if len(key) > 1:
                before = key[-2]
            held = (key[-1:], node[-1:])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["key", "node"])

    rows = classes.select("node", "sig").mapInArrow(keys, "key long, node long")
    rows = rows.repartitionByRange(F.col("key"), F.col("node")).sortWithinPartitions("key", "node")
    return shared.cut(rows.mapInArrow(fellows, "key long, node long"), "shared-keys")


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """a, b: each key's hub with its other members.

    All keys rank their members alike, by a hash, and take one of the first HUBS by the key's own hash. So
    a group that shares many keys meets a few hubs, again and again, and each member meets several.
    """
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= HUBS)
    sizes = first.groupBy("key").agg(F.max("rank").alias("c")).where("c > 1")
    hubs = first.join(sizes, "key").where(F.col("rank") == F.pmod(F.xxhash64("key"), F.col("c")) + 1).select("key", F.col("node").alias("hub"))
    pairs = rows.join(hubs, "key").where(F.col("node") != F.col("hub"))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs with `value` of both ends, as va and vb."""
    of = lambda end: table.select(F.col("node").alias(end), F.col(value).alias("v" + end))
    return pairs.join(of("a"), "a").join(of("b"), "b")


def _near_signatures(pairs: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose signatures are near and whose sets are of a size to be similar."""
    num, den = similarity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                va, vb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, VALUES) for c in ("va", "vb"))
                near = pa.array((va != vb).sum(axis=1) <= REACH)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(near), b.column("b").filter(near)], ["a", "b"])

    of = lambda end: classes.select(F.col("node").alias(end), F.col("n").alias("n" + end), F.col("sig").alias("v" + end))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return both.select("a", "b", "va", "vb").mapInArrow(each, "a long, b long").distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """node, items: the full shingle sets of the named documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, "t"):
            sets = shingle_sets(*shared.text_bytes(part.column("t")), shingle)
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array([x.tobytes() for x in sets], pa.large_binary()).cast(pa.binary())], ["node", "items"])

    own = _rows(docs, id_col, text_col).join(nodes.select(F.col("node").alias("i")).distinct(), "i", "left_semi")
    return shared.cut(own.mapInArrow(each, "node long, items binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are similar: num * |union| <= den * |intersection|."""
    num, den = similarity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("va"), b.column("vb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if min(len(x), len(y)) * den < num * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                good.append(len(x) + len(y) > 0 and den * inter >= num * (len(both) - inter))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], ["a", "b"])

    return _with(pairs, sets, "items").select("a", "b", "va", "vb").mapInArrow(each, "a long, b long").distinct()


def _brief(sets: DataFrame) -> DataFrame:
    """node, size, brief: each set's hashes cut to 16 bits (32 from BRIEF_16 items on). What two share of these is at least what the sets share."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("items")]
            brief = [x.astype(np.uint16 if len(x) <= BRIEF_16 else np.uint32).tobytes() for x in items]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(x) for x in items], pa.int64()), pa.array(brief, pa.binary())], ["node", "size", "brief"])

    return sets.mapInArrow(each, "node long, size long, brief binary")


def _meetings(size: np.ndarray, brief: list[np.ndarray], x: int, others: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """At least what set x has in common with each of the others. mark: 65536 times False, and so again."""
    if size[x] > BRIEF_16 or (size[others] > BRIEF_16).any():
        own = np.unique(brief[x].astype(np.uint16))
        return np.array([np.isin(brief[o].astype(np.uint16), own).sum() if min(size[o], size[x]) <= BRIEF_16 else np.isin(brief[o], brief[x]).sum() for o in others])
    mark[brief[x]] = True
    hits = mark[np.concatenate([brief[o] for o in others])]
    mark[brief[x]] = False
    return np.add.reduceat(hits, np.concatenate([[0], np.cumsum(size[others])[:-1]]), dtype=np.int64)


def _cross_pairs(rows: DataFrame, comps: DataFrame, briefs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """a, b: the pairs of a key whose ends are in different components so far and may be similar, by their brief sets."""
    num, den = similarity
    rows = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = rows.join(briefs.select("node", "size"), "node").groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.col("size") * 2 + 64).alias("bytes")).where("x < y")
    n = F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")
    rows = rows.join(sizes.select("key", n.alias("n")), "key")
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    rows = rows.select("key", "node", "comp", own.alias("own"), other.alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp")
    rows = rows.join(briefs, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def compare(node, comp, own, size, brief, lo, hi, mark) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Pairs of one block, or between two. The component with most members is only met, never led: its members don't meet each other."""
        left, right = [], []
        kinds, counts = np.unique(comp, return_counts=True)
        bulk = comp == kinds[counts.argmax()]
        at = np.arange(len(node))
        for x in np.flatnonzero(~bulk):
            good = (comp != comp[x]) & (bulk | (at > x)) & (den * np.minimum(size, size[x]) >= num * np.maximum(size, size[x]))
            if lo != hi:
                good &= own != own[x]
            others = np.flatnonzero(good)
            if len(others):
                both = _meetings(size, brief, x, others, mark)
                others = others[den * both >= num * (size[x] + size[others] - both)]
                left.append(np.full(len(others), node[x]))
                right.append(node[others])
        return left, right

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, rest = np.zeros(1 << 16, bool), None
        for b in _and_end(batches):
            table = b if rest is None else rest if b is None else pa.concat_batches([rest, b])
            if table is None or not table.num_rows:
                continue
            key, lo, hi, own, node, comp, size = (table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi", "own", "node", "comp", "size"))
            change = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            bounds = np.concatenate([[0], change, [len(key)]])
            whole = len(bounds) - 1 if b is None else len(bounds) - 2  # the last group may go on
            rest = table.slice(int(bounds[whole])) if b is not None else None
            stop = int(bounds[whole])
            brief = [np.frombuffer(v.as_buffer(), np.uint16 if k <= BRIEF_16 else np.uint32) for v, k in zip(table.column("brief").slice(0, stop), size, strict=False)]
            left, right = [], []
            for x, y in zip(bounds[:whole], bounds[1 : whole + 1], strict=True):
                some = compare(node[x:y], comp[x:y], own[x:y], size[x:y], brief[x:y], lo[x], hi[x], mark)
                left += some[0]
                right += some[1]
            if left:
                a, c = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    columns = rows.select("key", "lo", "hi", "own", "node", "comp", "size", "brief")
    return columns.mapInArrow(each, "a long, b long").distinct()


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    made = shared.cut(shared.compact(signatures(docs, shingle, id_col, text_col)), "signatures")
    named = made.where((F.col("n") > 0) & (F.col("i") != shared.NULL_ID))
    classes = shared.cut(named.groupBy("h1", "h2").agg(F.min("i").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    rows = _shared_keys(classes)
    sets = full_sets(docs, rows, shingle, id_col, text_col)
    first = shared.cut(_near_signatures(_hub_pairs(rows), classes, similarity), "hub-pairs")
    links = shared.cut(confirmed(first, sets, similarity), "links")
    so_far, briefs = components(links), shared.cut(shared.compact(_brief(sets)), "brief-sets")
    second = shared.cut(_cross_pairs(rows, so_far, briefs, similarity).join(first, ["a", "b"], "left_anti"), "cross-pairs")
    shared.drop(rows, so_far, briefs, first)
    more = shared.cut(confirmed(second, sets, similarity), "links")
    comps = components(links.unionByName(more))
    of_class = classes.select("h1", "h2", "node").join(comps, "node", "left").select("h1", "h2", F.coalesce("comp", "node").alias("comp"))
    of_class = shared.cut(of_class, "classes")
    shared.drop(classes, sets, links, second, more, comps)
    out = made.join(of_class, ["h1", "h2"], "left")
    named = F.col("i") != shared.NULL_ID
    found = F.when(named, F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("i")))
    return out.select(shared.null_if_lowest("i").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), (~named | (found == F.col("i"))).alias("kept"))
