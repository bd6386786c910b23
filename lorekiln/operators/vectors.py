"""A stored vector index: inverted lists of coarse centroids, residual codes in a file a list, exact distances for the best.

Centroids are the k-means of a bounded sample (SAMPLE_ROWS rows, taken by the hash of the id, the same at every run), so fitting costs the same at every size; all rows are then
dealt to their nearest centroid. A list is a partition of the table by `list`, and a row holds what is left of the unit vector after its centroid, one signed byte a dimension, and the scale of
those bytes, next to the columns that filters look at. A search ranks the centroids on the driver (LISTS_MOST of them at the most), reads the files of the `probes` nearest lists and no others,
ranks their rows by the coded vectors, and measures the `rerank` best of them exactly, from the vectors that are stored beside in ranges of ids.

How many lists to probe is measured when the index is built: TRIED rows of the sample are looked for in the whole sample, and the number is the least that meets SHARE of their ten nearest.
Vectors in groups need few lists, vectors without any structure most of them.

`exact` makes sure of the rest: by how far a list's rows lie from its centroid at most, and what a code is off at most, lists and rows that can't be among the k nearest
are left out, and all others are measured. `search.semantic` over the rows says the same without an index.

Vectors are compared by cosine. Null vectors, and those of length 0 or of another dimension than the index has, aren't indexed: their distance to anything is undefined. Equal distances are ordered by id.
Appended rows go to the lists of the centroids there are; a search finds them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.operators import search, tables

#: Rows that centroids are fitted on, at the most; rounds of fitting; lists, at the most. Lists grow with the root of the rows.
SAMPLE_ROWS, ROUNDS, LISTS_MOST = 65_536, 12, 4_096
#: Rows that the number of probes is measured with, and the share of their nearest that it must meet.
TRIED, SHARE = 256, 0.97
FILTERS = ("project", "source", "git_branch")


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows of unit length."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(rows: DataFrame, dimension: int | None = None) -> DataFrame:
    """Rows whose vector has a direction, as doubles."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    whole = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    if dimension:
        whole &= F.size("embedding") == dimension
    return rows.where(whole).withColumn("embedding", vector)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by k-means on the sphere; the first are spread over the sample, and one that loses all its vectors takes the worst placed one."""
    lists = min(lists, len(sample))
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own, near = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(norms < 1e-12)
        centres = sums / np.maximum(norms, 1e-12)[:, None]
        centres[lost] = sample[np.argsort(near, kind="stable")[: len(lost)]]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray, block: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    own, near = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for a in range(0, len(rows), block):
        like = rows[a : a + block] @ centres.T
        own[a : a + block] = like.argmax(axis=1)
        near[a : a + block] = like.max(axis=1)
    return own, near


def measured_probes(sample: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """The lists that the nearest of some of the sample lie in, by how near the lists are: as many as meet SHARE of them."""
    own, _ = _nearest(sample, centres)
    places = []
    for q in range(min(TRIED, len(sample))):
        like = sample @ sample[q]
        like[q] = -2
        best = np.argpartition(-like, min(k, len(like) - 1))[:k]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(-(centres @ sample[q]), kind="stable")] = np.arange(len(centres))
        places.append(place[own[best]])
    return int(np.quantile(np.concatenate(places), SHARE, method="higher")) + 1


def _coded(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with list, cosine (to the list's centroid), scale and code (a byte a dimension) in place of the embedding."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # LISTS_MOST rows at the most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("embedding"))
            own, near = _nearest(unit, sent.value)
            rest = unit - sent.value[own]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            columns = [pa.array(own), pa.array(near), pa.array(scale), pa.array([x.tobytes() for x in code], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *FILTERS)), *columns], _CODED_NAMES)

    told = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("id", *FILTERS)]
    return rows.select(*told, "embedding").mapInArrow(each, _CODED)


_CODED = "id string, project string, source string, git_branch string, list long, cosine double, scale double, code binary"
_CODED_NAMES = [x.split()[0] for x in _CODED.split(", ")]


def write(rows: DataFrame, path: str, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> int:
    """Builds the index of rows (id, embedding and the columns of FILTERS that they have); the number of lists. The dimension is the one that most rows have."""
    spark = rows.sparkSession
    first = usable(rows).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = usable(rows, first.n if first else None)
    lists = min(lists or max(1, round((first["count"] if first else 0) ** 0.5)), LISTS_MOST)
    sample = good.select(F.xxhash64("id").alias("h"), "id", "embedding").orderBy("h", "id").limit(sample_rows).select("embedding").toArrow().column(0).combine_chunks()
    unit = _matrix(sample) if len(sample) else np.zeros((0, 0))
    centres = fitted(unit, lists) if len(unit) else unit
    probes = measured_probes(unit, centres) if len(unit) else 0
    spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centres)], "list long, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _store(good, centres, path, "overwrite")
    return len(centres)


def _store(rows: DataFrame, centres: np.ndarray, path: str, mode: str) -> None:
    if not len(centres):
        rows = rows.limit(0)
    # a list may hold a third of all rows, so it is dealt out by a salt from the id as well
    coded = tables.kept(_coded(rows, centres), "coded")
    coded.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode(mode).partitionBy("list").parquet(f"{path}/lists")
    coded.groupBy("list").agg(F.min("cosine").alias("least")).coalesce(1).write.mode(mode).parquet(f"{path}/reach")
    rows.select(F.col("id").cast("string").alias("id"), "embedding").repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(f"{path}/vectors")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows whose ids the index doesn't have to the lists that there are."""
    spark = rows.sparkSession
    index = Index(spark, path)
    if len(index.centres):
        new = usable(rows, index.centres.shape[1]).join(spark.read.parquet(f"{path}/vectors").select("id"), "id", "left_anti")
        _store(tables.kept(new, "new-vectors"), index.centres, path, "append")


class Index:
    """What a search needs of an index on the driver: centroids and how far their lists reach, LISTS_MOST rows at the most."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        reach = spark.read.parquet(f"{path}/reach").groupBy("list").agg(F.min("least").alias("least"))
        rows = spark.read.parquet(f"{path}/centroids").join(reach, "list", "left").orderBy("list").collect()
        self.centres = np.array([r.centre for r in rows])
        self.least = np.array([1.0 if r.least is None else r.least for r in rows])
        self.empty = np.array([r.least is None for r in rows])
        self.probes = rows[0].probes if rows else 0

    def near(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The lists whose centroids are nearest to each of the vectors."""
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def within(self, unit: np.ndarray, similarity: float) -> list[int]:
        """The lists that may hold a row of that similarity."""
        turn = lambda x: np.arccos(np.clip(x, -1, 1))
        most = np.cos(np.maximum(turn(self.centres @ unit / np.linalg.norm(self.centres, axis=1)) - turn(self.least / np.linalg.norm(self.centres, axis=1)), 0))
        return np.flatnonzero((most >= similarity - 1e-9) & ~self.empty).tolist()

    def rows(self, lists: list[int], **filters: str | None) -> DataFrame:
        """The coded rows of lists. The files of others aren't opened."""
        table = self.spark.read.schema(_CODED).parquet(f"{self.path}/lists")
        return search.filtered(table.where(F.col("list").isin(lists) if lists else F.lit(False)), **filters)

    def likened(self, lists: list[int], unit: np.ndarray, **filters: str | None) -> DataFrame:
        """id, likeness, off: the cosine that the codes tell, and what it is off at most."""
        base = dict(enumerate((self.centres @ unit).tolist()))
        slack = float(np.abs(unit).sum()) / 2

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1)
                scale = batch.column("scale").to_numpy()
                like = (code @ unit) * scale + np.array([base[k] for k in batch.column("list").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(like), pa.array(scale * slack)], ["id", "likeness", "off"])

        return self.rows(lists, **filters).select("id", "list", "scale", "code").mapInArrow(each, "id string, likeness double, off double")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def nearest(spark: SparkSession, path: str, vector: list[float], k: int = 10, probes: int | None = None, rerank: int | None = None, exact: bool = False, min_relevance: float = 0.0, **filters: str | None) -> DataFrame:
    """id, distance (1 - cosine, measured) of k rows near the vector; with `exact`, of the k nearest."""
    index, wanted = Index(spark, path), np.array(vector, float)
    none = index.vectors().select("id", F.lit(0.0).alias("distance")).limit(0)
    if not len(index.centres) or len(wanted) != index.centres.shape[1] or not np.linalg.norm(wanted):
        return none
    unit = wanted / np.linalg.norm(wanted)
    best = index.likened(index.near(unit[None], probes or index.probes)[0].tolist(), unit, **filters).orderBy(F.desc("likeness"), "id").limit(max(rerank or 10 * k, k))
    ids = [r.id for r in best.select("id").collect()]  # rerank rows
    rows = index.vectors().where(F.col("id").isin(ids) if ids else F.lit(False))  # only row groups with these ids are read
    if exact:
        found = search.semantic(rows, vector, k).select("distance").collect()  # k rows
        least = 1 - found[-1].distance if len(found) == k else -2.0
        may = index.likened(index.within(unit, least), unit, **filters).where(F.col("likeness") + F.col("off") >= least - 1e-9).select("id")
        rows = index.vectors().join(may, "id", "left_semi")
    return search.semantic(rows, vector, k, min_relevance).select("id", "distance")


#: Query vectors that pass over the lists together.
BLOCK = 4_096


def nearest_many(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """query, rank, id, distance: k rows near each of the queries (id, embedding), which pass in blocks over the lists that they probe.

    A task keeps the `rerank` best of each query that it has met, so what is shuffled are that many rows a task and query at the most; hot lists are several tasks.
    """
    index, rerank = Index(spark, path), max(rerank or 10 * k, k)
    kind, out, block = "query string, id string, likeness double", None, []
    if not len(index.centres):
        return spark.createDataFrame([], "query string, rank int, id string, distance double")

    def scanned(block: list) -> DataFrame:
        unit = np.array([r.embedding for r in block])
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        near = index.near(unit, probes or index.probes)
        sent = spark.sparkContext.broadcast((unit, near, index.centres, [r.id for r in block]))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, near, centres, names = sent.value
            asks = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                own, ids = batch.column("list").to_numpy(), np.array(batch.column("id").to_pylist(), object)
                code, scale = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1), batch.column("scale").to_numpy()
                for c in np.unique(own):
                    at, who = np.flatnonzero(own == c), asks[int(c)]
                    like = (code[at] @ unit[who].T) * scale[at][:, None] + centres[c] @ unit[who].T
                    for j, q in enumerate(who):
                        l, i = like[:, j], ids[at]  # noqa: E741
                        if q in best:
                            l, i = np.concatenate([best[q][0], l]), np.concatenate([best[q][1], i])  # noqa: E741
                        top = np.lexsort((i, -l))[:rerank]
                        best[q] = l[top], i[top]
            for q, (l, i) in best.items():  # noqa: E741
                yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(i), pa.string()), pa.array(i.tolist(), pa.string()), pa.array(l)], ["query", "id", "likeness"])

        asked = index.rows(np.unique(near).tolist()).select("id", "list", "scale", "code").mapInArrow(each, kind)
        top = asked.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("likeness"), "id"))).where(F.col("r") <= rerank)
        return tables.kept(top.select("query", "id"), "candidates")

    for r in usable(queries, index.centres.shape[1]).select(F.col("id").cast("string").alias("id"), "embedding").toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            out, block = scanned(block) if out is None else out.unionByName(scanned(block)), []
    if block or out is None:
        made = scanned(block) if block else spark.createDataFrame([], "query string, id string")
        out = made if out is None else out.unionByName(made)
    both = out.join(index.vectors(), "id").join(usable(queries).select(F.col("id").cast("string").alias("query"), F.col("embedding").alias("wanted")), "query")
    measured = both.select("query", "id", (1 - search.cosine(F.col("embedding"), F.col("wanted"))).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return measured.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "distance")
