"""Sessions to chunks.

exchanges: session_id, source, project, git_branch, started_at, n (order in the session), role, content,
timestamp, tools array<string>. chunks: id, session_id, source, project, git_branch, content,
timestamp, chunk_index.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lorekiln.functions import text as T
from lorekiln.functions.patterns import SUMMARY_STOPWORDS

MAX_TOKENS = 800
SESSION = ("session_id", "source", "project", "git_branch", "started_at")
_PIECE = "struct<content:string,timestamp:string>"


def exchange_rows(exchanges: DataFrame) -> DataFrame:
    """Redacted text and token estimate of every exchange that isn't the system's."""
    text = T.exchange_text(F.col("role"), F.col("content"), F.col("tools"))
    return exchanges.where("role <> 'system'").withColumn("text", text).withColumn("tokens", T.token_estimate(F.col("text")))


def _fold(turns: Column, started_at: Column, most: int) -> Column:
    """Chunks of a session's ordered turns. A chunk that is closed by a turn takes that turn's time; the last takes the session's start."""
    none = F.array().cast(f"array<{_PIECE}>")
    start = F.struct(none.alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("size"))

    def close(s: Column, time: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(F.array_join(s["held"], "\n\n").alias("content"), time.alias("timestamp"))))

    def step(s: Column, t: Column) -> Column:
        over = (F.size(s["held"]) > 0) & (s["size"] + t["tokens"] > most)
        time = F.when(t["timestamp"] != "", t["timestamp"]).otherwise(started_at)
        return F.struct(
            F.when(over, close(s, time)).otherwise(s["done"]).alias("done"),
            F.when(over, F.array(t["text"])).otherwise(F.concat(s["held"], F.array(t["text"]))).alias("held"),
            F.when(over, t["tokens"]).otherwise(s["size"] + t["tokens"]).alias("size"),
        )

    return F.aggregate(turns, start, step, lambda s: F.when(F.size(s["held"]) > 0, close(s, started_at)).otherwise(s["done"]))


def chunk_id(session: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", session, index.cast("string")), 256), 1, 16)


def header() -> Column:
    """What a session's first chunk begins with."""
    branch = F.when(F.coalesce("git_branch", F.lit("")) != "", F.concat(F.lit(" | Branch: "), F.col("git_branch"))).otherwise("")
    return F.concat(F.lit("["), F.col("source"), F.lit("] Project: "), F.col("project"), branch, F.lit(" | "), F.col("started_at"), F.lit("\n\n"))


def chunks(exchanges: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """One shuffle by session; a session is folded where its turns are gathered. For sessions too long for that: `ranges.chunks`."""
    rows = exchange_rows(exchanges)
    turn = F.struct("n", "text", "tokens", "timestamp")
    by = rows.groupBy(*SESSION).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = by.select(*SESSION, F.posexplode(_fold(F.col("turns"), F.col("started_at"), most)).alias("chunk_index", "c"))
    content = F.when(F.col("chunk_index") == 0, F.concat(header(), F.col("c.content"))).otherwise(F.col("c.content"))
    return pieces.select(
        chunk_id(F.col("session_id"), F.col("chunk_index")).alias("id"), "session_id", "source", "project", F.coalesce("git_branch", F.lit("")).alias("git_branch"),
        content.alias("content"), F.col("c.timestamp").alias("timestamp"), "chunk_index",
    )


_PIECES = 64


def _most_frequent(n: int):
    """Of each row's words w the n most frequent that aren't stop words, ties by first place; a row's words are counted where they are."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _PIECES):
                part = batch.slice(a, _PIECES)
                counts = [Counter(x) for x in part.column("w").to_pylist()]
                for c in counts:
                    for w in SUMMARY_STOPWORDS:
                        c.pop(w, None)
                words = [[w for w, _ in c.most_common(n)] for c in counts]
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["w"]).columns, pa.array(words, pa.list_(pa.string()))], [*part.schema.names[:-1], "keywords"])

    return top


def keywords(texts: DataFrame, key: list[str], column: str, n: int) -> DataFrame:
    """key, keywords: the n most frequent words of each group's texts taken together; ties by first place. `n_order` orders them."""
    one = texts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n_order", column))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: x[column]), " ")
    words = one.select(*key, T.latin_words(whole).alias("w"))
    schema = StructType([*words.schema.fields[:-1], StructField("keywords", ArrayType(StringType()))])
    return words.mapInArrow(_most_frequent(n), schema).where(F.size("keywords") > 0)


def summaries(exchanges: DataFrame) -> DataFrame:
    """session_id, summary. files (array<string>) is used where exchanges have it."""
    by = exchanges.groupBy("session_id").agg(
        F.count_if(F.col("role").isin("human", "assistant")).alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("tools"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("files")))) if "files" in exchanges.columns else F.lit(0)).alias("files"),
    )
    humans = exchanges.where("role = 'human'").select("session_id", F.col("n").alias("n_order"), "content")
    out = by.join(keywords(humans, ["session_id"], "content", 5), "session_id", "left")
    about = F.when(F.size("keywords") > 0, F.concat(F.lit("about "), F.array_join(F.slice("keywords", 1, 4), ", ")))
    tools = F.when(F.size("tools") > 0, F.concat(F.lit("Tools: "), F.array_join(F.slice("tools", 1, 5), ", ")))
    files = F.when(F.col("files") > 0, F.concat(F.col("files").cast("string"), F.lit(" files modified")))
    parts = F.concat_ws(". ", F.concat(F.col("n").cast("string"), F.lit(" exchanges")), about, tools, files)
    return out.select("session_id", F.concat(parts, F.lit(".")).alias("summary"))


def new_rows(chunks: DataFrame, store: DataFrame, refresh: bool = False) -> DataFrame:
    """What an append writes: rows whose id isn't in the store; of repeated ids the earliest by time, place and content. refresh: changed rows as well."""
    order = F.struct(*[c for c in ("timestamp", "chunk_index", "content") if c in chunks.columns])
    chunks = chunks.groupBy("id").agg(F.min_by(F.struct(*[F.col(c) for c in chunks.columns]), order).alias("_row")).select("_row.*")
    if not refresh:
        return chunks.join(store.select("id"), "id", "left_anti")
    return chunks.join(store.select("id", F.col("content").alias("_old")), "id", "left").where("_old IS NULL OR _old <> content").drop("_old")


def ingest_stats(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """sessions_ingested, chunks_added, sessions_skipped."""
    added = new_rows(chunks, store).groupBy("session_id").agg(F.count("*").alias("added"))
    by = chunks.select("session_id").distinct().join(added, "session_id", "left")
    return by.agg(F.count_if(F.col("added") > 0).alias("sessions_ingested"), F.coalesce(F.sum("added"), F.lit(0).cast("long")).alias("chunks_added"), F.count_if(F.col("added").isNull()).alias("sessions_skipped"))


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a store, with the columns and types they were written with; empty where there is none. A rewrite that died between its renames is undone first."""
    store, at = _store(spark, path)
    if not store.exists(at):
        kept = sorted(str(f.getPath()) for f in store.globStatus(at.suffix(".old-*")) or [])
        if not kept:
            return spark.createDataFrame([], schema)
        store.rename(_store(spark, kept[-1])[1], at)
    return spark.read.schema(schema).parquet(path).select(schema.names)


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def rewrite(rows: DataFrame, path: str) -> None:
    """Makes rows all that the store has. They are written beside it whole, then take its place by renames; until these the store is as it was."""
    spark, tag = rows.sparkSession, uuid.uuid4().hex
    store, at = _store(spark, path)
    made, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    rows.withColumn("in_project", F.col("project")).write.partitionBy("in_project").parquet(made)
    if store.exists(at) and not store.rename(at, _store(spark, old)[1]):
        raise OSError(f"{path} couldn't be put aside")
    if not store.rename(_store(spark, made)[1], at):
        raise OSError(f"{made} couldn't take the place of {path}")
    store.delete(_store(spark, old)[1], True)


def append(chunks: DataFrame, path: str, refresh: bool = False) -> int:
    """Appends to a store in Parquet; the number of rows that it added. First write wins.

    Files are dealt into folders by `in_project`, a copy of project: the column itself stays in the files, so that "007", an
    empty or a null project come back as they were.
    """
    if refresh:
        raise ValueError("an append changes no rows; ingest.rewrite does")
    added = Observation()
    new = new_rows(chunks, stored(chunks.sparkSession, path, chunks.schema)).select(chunks.columns)
    new = new.observe(added, F.count(F.lit(1)).alias("n")).withColumn("in_project", F.col("project"))
    new.write.mode("append").partitionBy("in_project").parquet(path)
    return added.get["n"]
