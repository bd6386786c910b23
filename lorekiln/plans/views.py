"""The engine's model over the test tables: documents as chunks, conversations as exchanges, embeddings as vectors.

What the tables lack (projects, branches, times) follows from ids by arithmetic that the SQL repeats.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators import index as stored
from lorekiln.operators import tables, vectors

EPOCH = 1_704_067_200  # 2024-01-01
SOURCES = ("alpha", "beta", "gamma", "delta", "epsilon")
NOW = "2025-06-01T00:00:00"
#: Phrases for the detectors, since the tables' words are invented.
CUES = (
    "TODO: update the parser cache. ", "FIXME: handle broken pipe error in reader. ", "we should rewrite the loader module. ", "let's add retry logic to client. ", "need to refactor storage layer. ",
    "would be nice to document release steps. ", "add caching headers later ", "Fixed the parser cache update.\n", "implemented retry logic to client.\n", "don't commit generated files. ",
    "never push directly to main branch. ", "always run unit tests first. ", "use spaces instead of tabs here. ", "prefer composition over inheritance ", "avoid global mutable state. ",
    "remember to update the changelog file. ", "make sure to rebase feature branch. ", "We decided to use parquet storage. ", "we'll go with the async client. ", "chose redis over memcached for caching. ",
    "the plan is weekly releases. ", "migrating to postgres cluster. ", "replaced polling loop with webhooks. ", "connection timeout error in worker pool\n", "Traceback raised when parsing null config\n",
    "login page is not working after upgrade\n", "I told you to keep functions small. ", "picked sqlite instead of leveldb today. ", "stop using wildcard imports. TODO: update parser cache soon. ",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    branch = F.when(d % 3 == 0, "main").when(d % 3 == 1, "dev").otherwise("")
    time = iso(F.lit(EPOCH) + (d % 400) * 86400 + (d * 37) % 86400)
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"), F.concat(F.lit("s"), F.floor(d / 5).cast("string")).alias("session_id"), F.col("lang").alias("project"), "source", branch.alias("git_branch"),
        F.col("text").alias("content"), time.alias("timestamp"), (d % 5).cast("int").alias("chunk_index"),
    )


_stored: dict[tuple[str, ...], str] = {}


def _files(rows: DataFrame) -> str:
    """What the files of a table are: another state of the table is another index."""
    return hashlib.sha256("\n".join(sorted(str(tuple(r)) for r in rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect())).encode()).hexdigest()  # one row a file


def _once(spark: SparkSession, name: str, source: DataFrame, write) -> str:
    """The folder of an index of a table's present state, in the shared folder: built at an application's first search, gone when it ends."""
    key = (spark.sparkContext.applicationId, name, _files(source))
    if key not in _stored:
        path = tables.folder(spark, name)
        write(path)
        _stored[key] = path
    return _stored[key]


def index(spark: SparkSession, sf_dir: str, vectored: bool = False) -> str:
    """The stored index of the chunks, or of those that have a vector, as ingest keeps it."""
    rows = chunks(spark, sf_dir)
    if vectored:
        rows = rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id")), "id", "left_semi")
    return _once(spark, f"index-{'vectored' if vectored else 'all'}", table(spark, sf_dir, "documents"), lambda path: stored.write(rows, path))


def vector_index(spark: SparkSession, sf_dir: str) -> str:
    """The stored vector index of all embeddings."""
    source = table(spark, sf_dir, "embeddings")
    return _once(spark, "vectors", source, lambda path: vectors.write(source.select(F.col("vec_id").cast("string").alias("id"), "embedding"), path))


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has no more splits than there are cores: then it is small, and few of the splits hold a row group. Larger tables are read as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() > cores else rows.repartition(cores)


def cued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chunks after one of the phrases, and every third after a second."""
    d = F.col("id").cast("long")
    cue = lambda k: F.element_at(F.array(*map(F.lit, CUES)), (k % len(CUES) + 1).cast("int"))
    text = F.concat(cue(d), F.when(d % 3 == 0, cue(d * 7 + 3)).otherwise(""), F.col("content"))
    return spread(chunks(spark, sf_dir)).withColumn("content", text)


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    role = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    tools = F.when((F.col("role") == "assistant") & (t % 3 == 1), F.array(F.lit("Read"), F.lit("Edit"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), c.cast("string")).alias("session_id"), F.element_at(F.array(*map(F.lit, SOURCES)), (c % 5 + 1).cast("int")).alias("source"), F.concat(F.lit("proj-"), (c % 7).cast("string")).alias("project"),
        F.when(c % 2 == 0, "main").otherwise("").alias("git_branch"), iso(F.lit(EPOCH) + c * 86400).alias("started_at"), t.cast("long").alias("n"), role.alias("role"), F.col("text").alias("content"),
        iso(F.lit(EPOCH) + c * 86400 + t * 60).alias("timestamp"), tools.alias("tools"),
    )


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _iso_sql(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


CHUNKS_SQL = f"""chunks AS (
  SELECT doc_id::VARCHAR AS id, 's' || (doc_id // 5) AS session_id, lang AS project, source, CASE doc_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' ELSE '' END AS git_branch,
         text AS content, {_iso_sql(f"{EPOCH} + (doc_id % 400) * 86400 + (doc_id * 37) % 86400")} AS timestamp, (doc_id % 5)::INTEGER AS chunk_index
  FROM documents)"""
CUED_SQL = f"""{CHUNKS_SQL}, cued AS (
  SELECT * REPLACE (({quoted(CUES)})[id::BIGINT % {len(CUES)} + 1] || CASE WHEN id::BIGINT % 3 = 0 THEN ({quoted(CUES)})[(id::BIGINT * 7 + 3) % {len(CUES)} + 1] ELSE '' END
    || content AS content) FROM chunks)"""
EXCHANGES_SQL = f"""exchanges AS (
  SELECT 'c' || conv_id AS session_id, ({quoted(SOURCES)})[conv_id % 5 + 1] AS source, 'proj-' || (conv_id % 7) AS project, CASE conv_id % 2 WHEN 0 THEN 'main' ELSE '' END AS git_branch,
         {_iso_sql(f"{EPOCH} + conv_id * 86400")} AS started_at, turn AS n, CASE role WHEN 'user' THEN 'human' ELSE role END AS role, text AS content,
         {_iso_sql(f"{EPOCH} + conv_id * 86400 + turn * 60")} AS timestamp, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN ['Read', 'Edit'] ELSE []::VARCHAR[] END AS tools
  FROM conversations)"""
