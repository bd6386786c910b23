"""The inverted index as a store of immutable segments: appends, deletes, merges, and searches over one snapshot.

An append writes a segment: its rows with their words, and postings. A task sorts the postings of its rows by (term, falling level, id) in runs of a bounded number
of words, one behind the other; no posting is shuffled. Pages are small, and those of a run that hold none of a search's terms are left out by their bounds. A posting holds the row's length and
the columns that filters look at, so a search reads the postings of its terms and nothing else. A delete writes tombstones, (segment, id); what they take from the corpus figures is written with
them, so rows and mean length are sums over the manifest. A merge makes one segment of several of a size, without the rows that tombstones name: it drops those among the rows, whose words it
has, and makes the postings of what is left in full runs, so neither texts nor postings are read for it.

The manifest is a log of numbered files, each of which names a whole state; the highest number is the present. A change is put under the next number by a rename that
fails if another writer was there first, and is then worked out again from the new state. What a killed job leaves isn't named by the log; `sweep` removes it. (The rename
decides among writers where the store has an atomic one, as HDFS and local disks do.)

The level of a posting is its part of BM25 that doesn't rest on the corpus, in steps. A search counts its terms' postings by level first, for which it reads those two columns alone; so for a
query of one word it knows which levels can't hold one of the best k, and leaves the rest of them unread. What a search finds equals `search.keyword` over the surviving rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.operators import search, tables

FILTERS = ("project", "source", "git_branch")
TOLD = ("session_id", *FILTERS)
_FILTERS = ", ".join(f"{c} string" for c in FILTERS)
ROWS = f"segment string, id string, session_id string, {_FILTERS}, dl int"
WORDS = f"{ROWS}, words string"
POSTINGS = f"term string, level int, id string, {_FILTERS}, dl int, tf long, positions array<int>"
DEAD = "segment string, id string, dl int"
#: Steps of a posting's level between 0 and the most that a term can add.
LEVELS = 32
#: Segments of a size that a merge makes one of.
FAN = 8
#: Words of a run, whose postings a task sorts at once; a row is in one run whatever its length.
RUN = 1 << 21
#: Postings of a page at most, the least that a search reads of a run.
PAGE = 4096


class Conflict(Exception):
    """Another writer took the number."""


class Log:
    """The manifest: numbered states, of which a reader holds one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.load()

    def load(self) -> None:
        jvm, at = self.spark._jvm, self._path(f"{self.path}/log")
        names = [f.getPath().getName() for f in self._store.listStatus(at)] if self._store.exists(at) else []
        self.number = max((int(x[:-5]) for x in names if x.endswith(".json")), default=0)
        state = {"segments": [], "dead": []}
        if self.number:
            state = json.loads(jvm.org.apache.commons.io.IOUtils.toString(self._store.open(self._path(f"{self.path}/log/{self.number:012}.json")), "UTF-8"))
        self.segments: list[dict] = state["segments"]
        self.dead: list[dict] = state["dead"]

    def commit(self, segments: list[dict], dead: list[dict]) -> None:
        """Makes this the state after the one that was read, or raises Conflict."""
        jvm = self.spark._jvm
        made, wanted = self._path(f"{self.path}/log/{uuid.uuid4().hex}.tmp"), self._path(f"{self.path}/log/{self.number + 1:012}.json")
        out = self._store.create(made, False)
        out.write(bytearray(json.dumps({"segments": segments, "dead": dead}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._store.getUri(), self.spark._jsc.hadoopConfiguration()).rename(made, wanted, none)
        except Exception as e:
            self._store.delete(made, False)
            if self._store.exists(wanted):
                raise Conflict(str(wanted)) from e
            raise
        self.number, self.segments, self.dead = self.number + 1, segments, dead

    def rows(self) -> int:
        return sum(s["rows"] for s in self.segments) - sum(d["rows"] for d in self.dead)

    def length(self) -> int:
        return sum(s["length"] for s in self.segments) - sum(d["length"] for d in self.dead)

    def table(self, kind: str, schema: str, names: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{s['name']}/{kind}" for s in (self.dead if kind == "dead" else self.segments) if names is None or s["name"] in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def postings(self, terms: list[str]) -> DataFrame:
        """These terms' postings, dead ones too, with the segment, which their folder says."""
        found = self.table("postings", POSTINGS).where(F.col("term").isin(terms))
        return found.withColumn("segment", F.element_at(F.split("_metadata.file_path", "/"), -3) if self.segments else F.lit(None).cast("string"))

    def alive(self, found: DataFrame) -> DataFrame:
        """Without what tombstones name."""
        return found.join(self.table("dead", DEAD).select("segment", "id"), ["segment", "id"], "left_anti") if self.dead else found


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def _run(held: list[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """The postings of rows, by (term, falling level, id)."""
    rows = pa.Table.from_batches(held).sort_by("id").combine_chunks().to_batches()[0]
    dl = rows["dl"].to_numpy().astype(np.int64)
    words = pc.split_pattern(rows["words"], " ").flatten().dictionary_encode()
    n, terms = len(words), words.dictionary
    rank = np.empty(len(terms), np.int64)
    rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
    bits = n.bit_length()
    # a word's number among the run's words says its row and its place
    key = np.sort(rank[words.indices.to_numpy()] << bits | np.arange(n))
    at, word = key & ((1 << bits) - 1), key >> bits
    row = np.repeat(np.arange(len(dl)), dl)[at]
    places = at - (np.cumsum(dl) - dl)[row]
    first = _changes(word, row)
    tf, word, row = np.diff(first, append=n), word[first], row[first]
    # the gain without its idf, in LEVELS steps up to K1 + 1, its limit
    level = np.floor(LEVELS * tf / (tf + search.K1 * (1 - search.B + search.B * dl[row] / (mean or 1.0)))).astype(np.int64)
    order = np.sort((word * (LEVELS + 1) + LEVELS - level) << bits | np.arange(len(first))) & ((1 << bits) - 1)
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), pa.array(places, pa.int32()))
    names, terms = [x.split()[0] for x in POSTINGS.split(", ")], terms.take(pc.sort_indices(terms))
    for a in range(0, len(order), 1 << 16):
        some = order[a : a + (1 << 16)]
        told = rows.select(["id", *FILTERS, "dl"]).take(pa.array(row[some]))
        made = dict(zip(told.schema.names, told.columns)) | {"term": terms.take(pa.array(word[some])), "level": pa.array(level[some], pa.int32()), "tf": pa.array(tf[some], pa.int64()), "positions": positions.take(pa.array(some))}
        yield pa.RecordBatch.from_arrays([made[x] for x in names], names)


def _runs(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """The postings of a task's rows, run by run."""
    held, n = [], 0
    for batch in batches:
        batch = batch.filter(pc.greater(batch["dl"], 0))
        ends, a = np.cumsum(batch["dl"].to_numpy(), dtype=np.int64), 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = min(int(np.searchsorted(ends, before + RUN - n)) + 1, batch.num_rows)  # with the row that fills the run
            held.append(batch.slice(a, b - a))
            a, n = b, n + int(ends[b - 1] - before)
            if n >= RUN:
                yield from _run(held, mean)
                held, n = [], 0
    if held:
        yield from _run(held, mean)


def _write_postings(found: DataFrame, path: str, name: str, mean: float) -> None:
    """A segment's postings, from its rows with their words. Few small files are dealt over all cores, since a file may be one task's."""
    cores = found.sparkSession.sparkContext.defaultParallelism
    if len(found.inputFiles()) < cores and found.rdd.getNumPartitions() <= cores:
        found = found.repartition(cores)
    found.mapInArrow(partial(_runs, mean=mean), POSTINGS).write.option("parquet.page.row.count.limit", PAGE).parquet(f"{path}/{name}/postings")


def _from_words(spark: SparkSession, path: str, name: str) -> dict:
    """Completes a segment whose rows are there with their words; what the manifest says of it."""
    rows = spark.read.schema(WORDS).parquet(f"{path}/{name}/rows")
    n, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    mean = length / n if n else 1.0
    _write_postings(rows.select("id", *FILTERS, "dl", "words"), path, name, mean)
    return {"name": name, "rows": n, "length": int(length), "mean": mean}


def _segment(rows: DataFrame, path: str) -> dict:
    """Writes a segment of rows (id, content and the columns of TOLD that they have); what the manifest says of it."""
    name = f"segment-{uuid.uuid4().hex}"
    told = [(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in TOLD]
    words = rows.select(F.lit(name).alias("segment"), F.col("id").cast("string").alias("id"), *told, search.T.terms(F.coalesce("content", F.lit(""))).alias("t"))
    words.select("segment", "id", *TOLD, F.size("t").alias("dl"), F.array_join("t", " ").alias("words")).write.parquet(f"{path}/{name}/rows")
    return _from_words(rows.sparkSession, path, name)


def _first(rows: DataFrame) -> DataFrame:
    """One row for each id that isn't null: of several that whose content comes first. Only texts of ids that are there more than once are moved for that."""
    rows = rows.where("id IS NOT NULL").withColumn("_id", F.col("id").cast("string"))
    twice = tables.kept(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_id"), "repeated-ids")
    if twice.isEmpty():
        return rows.drop("_id")
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("content"))
    some = rows.join(twice, "_id", "left_semi").withColumn("_first", rank).where("_first = 1").drop("_first")
    return rows.join(twice, "_id", "left_anti").unionByName(some).drop("_id")


def write(rows: DataFrame, path: str) -> int:
    """An index of these rows and no others, whatever was there before; the number of rows."""
    log, made = Log(rows.sparkSession, path), _segment(_first(rows), path)
    while True:
        try:
            log.commit([made], [])
            return made["rows"]
        except Conflict:
            log.load()


def append(rows: DataFrame, path: str) -> int:
    """Adds the rows whose ids the index doesn't have; how many. Of two writers the first keeps an id."""
    spark = rows.sparkSession
    log, given = Log(spark, path), rows.where("id IS NOT NULL").select(F.col("id").cast("string").alias("_new"))
    while True:
        new = tables.kept(given.distinct().join(log.alive(log.table("rows", ROWS)).select(F.col("id").alias("_new")).hint("merge"), "_new", "left_anti"), "new-ids")
        if new.isEmpty():
            return 0
        made = _segment(_first(rows.join(new, F.col("id").cast("string") == F.col("_new"), "left_semi")), path)
        seen = {s["name"] for s in log.segments}
        while True:
            try:
                log.commit([*log.segments, made], log.dead)
                return made["rows"]
            except Conflict:
                log.load()
                others = [s["name"] for s in log.segments if s["name"] not in seen]
                if others and not log.table("rows", ROWS, others).join(spark.read.schema(ROWS).parquet(f"{path}/{made['name']}/rows").select("id"), "id", "left_semi").isEmpty():
                    break  # some ids have come meanwhile


def delete(spark: SparkSession, path: str, session_id: str | None = None, ids: list[str] | None = None, everything: bool = False, **filters: str | None) -> int:
    """Deletes the rows of a session, with these ids, or for which all filters hold (or everything, if said so); how many."""
    log = Log(spark, path)
    while True:
        rows = search.filtered(log.alive(log.table("rows", ROWS)), **filters)
        if session_id:
            rows = rows.where(F.col("session_id") == session_id)
        if ids is not None:
            rows = rows.where(F.col("id").isin(ids) if ids else F.lit(False))
        if not everything and not session_id and ids is None and not any(filters.values()):
            return 0
        name = f"dead-{uuid.uuid4().hex}"
        rows.select("segment", "id", "dl").write.parquet(f"{path}/{name}/dead")
        n, length = spark.read.schema(DEAD).parquet(f"{path}/{name}/dead").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not n:
            return 0
        try:
            log.commit(log.segments, [*log.dead, {"name": name, "rows": n, "length": int(length)}])
            return n
        except Conflict:
            log.load()


def merge(spark: SparkSession, path: str, fan: int = FAN, everything: bool = False) -> int:
    """Makes one segment of `fan` or more of a size and of those that are half dead (or of all), without the dead; how many segments went."""
    log = Log(spark, path)
    gone = {r.segment: (r.n, r.length) for r in log.table("dead", DEAD).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")).collect()}  # one row a segment
    sizes: dict[int, list[dict]] = {}
    for s in log.segments:
        left = s["rows"] - gone.get(s["name"], (0, 0))[0]
        sizes.setdefault(-1 if 2 * left < s["rows"] else int(math.log(max(left, 1), fan)), []).append(s)
    chosen = [s for tier, some in sizes.items() if everything or tier == -1 or len(some) >= fan for s in some]
    if not chosen:
        return 0
    names = [s["name"] for s in chosen]
    name = f"segment-{uuid.uuid4().hex}"
    log.alive(log.table("rows", WORDS, names)).withColumn("segment", F.lit(name)).select(*[x.split()[0] for x in WORDS.split(", ")]).write.parquet(f"{path}/{name}/rows")
    made = _from_words(spark, path, name)
    keep = [s for s in log.segments if s["name"] not in names]
    dead = log.table("dead", DEAD).where(~F.col("segment").isin(names))
    left = []
    if log.dead:
        tomb = f"dead-{uuid.uuid4().hex}"
        dead.write.parquet(f"{path}/{tomb}/dead")
        rest = [gone[x] for x in gone if x not in names]
        left = [{"name": tomb, "rows": sum(x[0] for x in rest), "length": int(sum(x[1] for x in rest))}] if rest else []
    try:
        log.commit([*keep, *([made] if made["rows"] else [])], left)
    except Conflict:
        return 0  # a later merge will find more
    return len(names)


def sweep(spark: SparkSession, path: str) -> int:
    """Removes folders that the present state doesn't name. Not while others write or read older states."""
    log = Log(spark, path)
    named = {s["name"] for s in [*log.segments, *log.dead]} | {"log"}
    stale = [f.getPath() for f in log._store.listStatus(log._path(path)) if f.getPath().getName() not in named]
    for at in stale:
        log._store.delete(at, True)
    return len(stale)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The surviving rows: id, session_id, project, source, git_branch, dl."""
    log = Log(spark, path)
    return log.alive(log.table("rows", ROWS)).drop("segment")


def figures(spark: SparkSession, path: str) -> tuple[int, float]:
    """Rows and their mean length, from the manifest alone."""
    log = Log(spark, path)
    return log.rows(), log.length() / log.rows() if log.rows() else 0.0


def _shifted(by: int) -> Column:
    return F.transform("positions", lambda p: p - by)


def places(postings: DataFrame, phrase: list[str]) -> DataFrame:
    """The rows of the first word's postings where the phrase stands, f: how often; its words' positions are shifted on to its first word's and met."""
    of = lambda k: postings.where(F.col("term") == phrase[k])
    if len(phrase) == 1:
        return of(0).withColumn("f", F.col("tf")).drop("positions")
    out = of(0).withColumn("at", F.col("positions")).drop("positions")
    for k in range(1, len(phrase)):
        out = out.join(of(k).select("segment", "id", _shifted(k).alias("more")), ["segment", "id"]).withColumn("at", F.array_intersect("at", "more")).drop("more")
    return out.withColumn("f", F.size("at").cast("long")).where("f > 0").drop("at")


def _least_level(log: Log, counts: dict[int, int], mean: float, k: int) -> int:
    """The level below which no posting of a term is among the best k: enough others are surely better.

    Levels rest on the mean length that their segment had; against today's mean a gain is off by the means' ratio at most.
    """
    drift = [s["mean"] / mean for s in log.segments if s["mean"] and mean]
    up, down = max([1.0, *(1 / x for x in drift)]), min([1.0, *(1 / x for x in drift)])
    sure, needed = 0, k + sum(d["rows"] for d in log.dead)
    for level in sorted(counts, reverse=True):
        sure += counts[level]
        if sure >= needed:
            return max(math.floor(level * down / up - 1e-9), 0)  # a posting below ends before (its level + 1) * up
    return 0


def reading(spark: SparkSession, path: str, query: str, k: int = 10, **filters: str | None) -> dict:
    """What a search for a query reads: postings read and skipped, and the least level."""
    return _reading(Log(spark, path), search.phrases(spark, query), k, any(filters.values()))


def _reading(log: Log, wanted: list[list[str]], k: int, filtered: bool) -> dict:
    terms = sorted({t for p in wanted for t in p})
    counts: dict[str, dict[int, int]] = {t: {} for t in terms}
    if terms:
        for r in log.table("postings", POSTINGS).where(F.col("term").isin(terms)).groupBy("term", "level").agg(F.count(F.lit(1)).alias("n")).collect():  # LEVELS rows a term at most
            counts[r.term][r.level] = r.n
    least = 0
    if len(wanted) == len(terms) == 1 and not filtered and log.rows():
        least = _least_level(log, counts[terms[0]], log.length() / log.rows(), k)
    every = sum(sum(c.values()) for c in counts.values())
    skipped = sum(n for c in counts.values() for level, n in c.items() if level < least)
    return {"counts": {t: sum(c.values()) for t, c in counts.items()}, "least": least, "read": every - skipped, "skipped": skipped}


def keyword(spark: SparkSession, path: str, query: str, k: int = 10, **filters: str | None) -> DataFrame:
    """id, bm25 of the best k rows that have every phrase of the query."""
    log, wanted = Log(spark, path), search.phrases(spark, query)
    none = spark.createDataFrame([], "id string, bm25 double")
    if not wanted or not log.rows():
        return none
    plan = _reading(log, wanted, k, any(filters.values()))
    if not all(plan["counts"].values()):
        return none  # a word that stands nowhere
    n, mean = log.rows(), log.length() / log.rows()
    postings = log.alive(log.postings(sorted(plan["counts"])))
    hits, score = None, F.lit(0.0)
    for j, phrase in enumerate(sorted(wanted, key=lambda p: min(plan["counts"][t] for t in p))):
        found = places(postings, phrase)
        if len(phrase) == 1 and not log.dead:
            nk = F.lit(float(plan["counts"][phrase[0]]))
        else:
            nk = found.agg(F.count(F.lit(1)).cast("double")).scalar()
        best = search.filtered(found.where(F.col("level") >= plan["least"]) if plan["least"] else found, **filters)
        if hits is None:
            hits = best.select("segment", "id", "dl", F.col("f").alias(f"_f{j}"))
        else:
            hits = hits.join(best.select("segment", "id", F.col("f").alias(f"_f{j}")), ["segment", "id"])
        score = score + search.gain(F.lit(float(n)), nk, F.col(f"_f{j}").cast("double"), F.col("dl"), F.lit(mean))
    return hits.select("id", (-score).alias("bm25")).orderBy("bm25", "id").limit(k)
