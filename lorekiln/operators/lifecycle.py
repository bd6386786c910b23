"""Statistics, deletes, archiving, export and rendering."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorekiln.functions import text as T
from lorekiln.operators import ingest
from lorekiln.operators.ingest import keywords

ARCHIVED = "-archived"


def stats(chunks: DataFrame) -> DataFrame:
    """kind (all, project, source), name, chunks, sessions: one pass."""
    sets = chunks.groupingSets([[], ["project"], ["source"]], "project", "source").agg(F.count("*").alias("chunks"), F.count_distinct("session_id").alias("sessions"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "project").otherwise("source")
    return sets.select(kind.alias("kind"), F.coalesce("project", "source", F.lit("")).alias("name"), "chunks", "sessions")


def wake_up(chunks: DataFrame, top: int = 5) -> DataFrame:
    """sessions, chunks, sources, projects: the largest, as `name (n)`."""
    whole = chunks.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"))
    best = chunks.groupBy("project").count().orderBy(F.desc("count"), "project").limit(top)
    named = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "project"))).alias("p"))
    names = named.select(F.array_join(F.transform("p", lambda x: F.concat(x["project"], F.lit(" ("), (-x["c"]).cast("string"), F.lit(")"))), ", ")).scalar()
    return whole.withColumn("projects", names)


def deleted(chunks: DataFrame, project: str | None = None, source: str | None = None, session: str | None = None, everything: bool = False) -> DataFrame:
    """What stays. everything goes before session, session before project, project before source."""
    if everything:
        return chunks.where(F.lit(False))
    for name, value in (("session_id", session), ("project", project), ("source", source)):
        if value:
            return chunks.where(~F.col(name).eqNullSafe(value))
    return chunks


def rollup(chunks: DataFrame) -> DataFrame:
    """Per session: its span, names and whether it is archived."""
    time = F.when(F.col("timestamp") != "", F.col("timestamp"))
    at = F.struct("chunk_index", "id")
    return chunks.groupBy("session_id").agg(
        F.coalesce(F.min(time), F.lit("")).alias("min_ts"), F.coalesce(F.max(time), F.lit("")).alias("max_ts"), F.min_by("project", at).alias("project"), F.min_by("source", at).alias("source"),
        F.min_by("git_branch", at).alias("git_branch"), F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"), F.bool_or(F.col("id").endswith(ARCHIVED)).alias("archived"),
    )


def candidates(chunks: DataFrame, cutoff: str) -> DataFrame:
    """Sessions whose last chunk is older than the cutoff. Chunks without a session belong to none; archived sessions, and those without a time, stay."""
    return rollup(chunks).where("coalesce(session_id, '') <> ''").where(~F.col("archived") & (F.col("max_ts") != "") & (F.col("max_ts") < cutoff))


def condensed(chunks: DataFrame, sessions: DataFrame, topics: int = 8, most: int = 200) -> DataFrame:
    """One short chunk for each of the sessions: span, topics, how it opened and closed."""
    rows = chunks.join(sessions.select("session_id"), "session_id", "left_semi")
    at = F.struct("chunk_index", "id")
    ends = rows.groupBy("session_id").agg(F.min_by("content", at).alias("head"), F.max_by("content", at).alias("tail"))
    words = keywords(rows.withColumn("n_order", at), ["session_id"], "content", topics)
    out = sessions.join(ends, "session_id").join(words, "session_id", "left")
    short = lambda c: T.strip(F.translate(F.substring(c, 1, most), "\n", " "))
    day = lambda c: F.substring(c, 1, 10)
    span = F.when(F.col("max_ts") == "", "").when(day("min_ts") != day("max_ts"), F.concat(F.lit(", "), day("min_ts"), F.lit(" → "), day("max_ts"))).otherwise(F.concat(F.lit(", "), day("min_ts")))
    head = F.concat(F.lit("[ARCHIVED session "), F.col("session_id"), F.lit("] "), F.col("n_chunks").cast("string"), F.lit(" chunks"), span, F.lit(" · project "), F.when(F.col("project") != "", F.col("project")).otherwise("?"))
    opened, closed = short(F.col("head")), short(F.col("tail"))
    content = F.concat_ws(
        "\n", head, F.when(F.size("keywords") > 0, F.concat(F.lit("Topics: "), F.array_join("keywords", ", "))), F.when(opened != "", F.concat(F.lit("Opened with: "), opened, F.lit("…"))),
        F.when((closed != "") & (closed != opened), F.concat(F.lit("Closed with: "), closed, F.lit("…"))),
    )
    return out.select(
        F.concat("session_id", F.lit(ARCHIVED)).alias("id"), "session_id", "source", "project", F.coalesce("git_branch", F.lit("")).alias("git_branch"), content.alias("content"),
        F.when(F.col("min_ts") != "", F.col("min_ts")).otherwise(F.col("max_ts")).alias("timestamp"), F.lit(0).alias("chunk_index"),
    )


def archived(chunks: DataFrame, cutoff: str) -> DataFrame:
    """The store after archiving: old sessions give way to their condensed chunk."""
    old = candidates(chunks, cutoff)
    return chunks.join(old.select("session_id"), "session_id", "left_anti").unionByName(condensed(chunks, old).select(*chunks.columns))


def archive_stats(chunks: DataFrame, cutoff: str) -> DataFrame:
    old = candidates(chunks, cutoff)
    made = condensed(chunks, old)
    after = made.agg(F.coalesce(F.sum(F.length("content")), F.lit(0).cast("long"))).scalar()
    return old.agg(F.count("*").alias("sessions_archived"), F.coalesce(F.sum("n_chunks"), F.lit(0).cast("long")).alias("chunks_before"), F.count("*").alias("chunks_after"), F.coalesce(F.sum("n_chars"), F.lit(0).cast("long")).alias("chars_before")).withColumn("chars_after", after)


def archive_counters(chunks: DataFrame, cutoff: str) -> DataFrame:
    """One row: what archiving does, or would do."""
    old = candidates(chunks, cutoff)
    seen = rollup(chunks).where("coalesce(session_id, '') <> ''").agg(F.count("*").alias("sessions_considered"), F.count_if("archived").alias("sessions_already_archived"))
    gone = old.agg(F.count("*").alias("sessions_archived"), F.coalesce(F.sum("n_chunks"), F.lit(0).cast("long")).alias("chunks_removed"), F.coalesce(F.sum("n_chars"), F.lit(0).cast("long")).alias("bytes_before"))
    made = condensed(chunks, old).agg(F.count("*").alias("chunks_added"), F.coalesce(F.sum(F.length("content")), F.lit(0).cast("long")).alias("bytes_after"))
    told = {c: of.select(c).scalar() for of in (gone, made) for c in of.columns}
    out = seen.withColumns(told)
    return out.select("sessions_considered", "sessions_archived", "sessions_already_archived", "chunks_removed", "chunks_added", "bytes_before", "bytes_after")


def archive(spark: SparkSession, path: str, schema: StructType, cutoff: str, project: str | None = None, dry_run: bool = False) -> dict[str, int]:
    """Archives old sessions of a store (or of one project) and writes it, unless dry_run; the counters. A second run finds nothing to do."""
    rows = ingest.stored(spark, path, schema)
    mine = rows.where(F.col("project") == project) if project else rows
    counted = archive_counters(mine, cutoff).first().asDict()
    if counted["sessions_archived"] and not dry_run:
        new = archived(mine, cutoff)
        ingest.rewrite(new.unionByName(rows.where(~F.col("project").eqNullSafe(project))) if project else new, path)
    return counted


def delete(spark: SparkSession, path: str, schema: StructType, **which: object) -> int:
    """Deletes rows of a store as `deleted` says, and writes it; how many went."""
    rows = ingest.stored(spark, path, schema)
    left = deleted(rows, **which)
    gone = rows.count() - left.count()
    if gone:
        ingest.rewrite(left, path)
    return gone


def exported(chunks: DataFrame, project: str | None = None) -> DataFrame:
    """id, and one JSON object a row."""
    rows = chunks.where(F.col("project") == project) if project else chunks
    return rows.select("id", F.to_json(F.struct("id", "content", "session_id", "project", "source", "timestamp", "chunk_index")).alias("json"))


def export_markdown(chunks: DataFrame) -> DataFrame:
    head = F.concat(F.lit("## "), F.col("project"), F.lit(" — "), F.substring("timestamp", 1, 10))
    return chunks.select("id", F.concat(head, F.lit("\n\n"), F.col("content"), F.lit("\n")).alias("block"))


def daily_digest(sessions: DataFrame) -> DataFrame:
    """date, digest; sessions: session_id, project, git_branch, started_at, exchanges (of humans), summary."""
    date = F.when(F.coalesce("started_at", F.lit("")) != "", F.substring("started_at", 1, 10)).otherwise("unknown")
    branch = F.when(F.coalesce("git_branch", F.lit("")) != "", F.concat(F.lit(" on "), F.col("git_branch"))).otherwise("")
    line = F.concat(F.lit("- [["), T.sanitized(F.col("session_id")), F.lit("]] "), F.col("project"), F.lit(": "), F.col("exchanges").cast("string"), F.lit(" exchanges"), branch, F.lit(". "), F.col("summary"))
    rows = sessions.select(date.alias("date"), "session_id", line.alias("line"))
    return rows.groupBy("date").agg(F.concat(F.lit("# "), F.first("date"), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "line"))), lambda x: x["line"]), "\n")).alias("digest"))


def transcript(exchanges: DataFrame, ends: int = 30, most: int = 2000, total: int = 800_000) -> DataFrame:
    """session_id, transcript: what people and assistants said, without secrets.

    Of more than 2 * ends exchanges, of whatever role, the first and last; each is cut by bytes, and so is the whole. Exchanges of
    other roles count but aren't shown. A session of which nothing is shown has an empty transcript.
    """
    w = Window.partitionBy("session_id")
    rows = exchanges.withColumn("_n", F.row_number().over(w.orderBy("n"))).withColumn("_c", F.count("*").over(w))
    rows = rows.where((F.col("_c") <= 2 * ends) | (F.col("_n") <= ends) | (F.col("_n") > F.col("_c") - ends))
    tools = F.when((F.col("role") == "assistant") & (F.size("tools") > 0), F.concat(F.lit("\n> Tools: "), F.array_join("tools", ", "))).otherwise("")
    head = F.when(F.col("role") == "human", "### You").when(F.col("role") == "assistant", F.concat(F.lit("### Assistant"), tools))
    rows = rows.withColumn("_s", T.redact(F.coalesce("content", F.lit(""))))
    said = F.concat(head, F.lit("\n"), T.utf8_truncate(F.col("_s"), most))  # null for other roles
    gap = F.when((F.col("_c") > 2 * ends) & (F.col("_n") == ends), F.concat(F.lit("*["), (F.col("_c") - 2 * ends).cast("string"), F.lit(" exchanges omitted; full content in the store]*")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_n", "p"))), lambda x: x["p"])
    by = rows.select("session_id", "_n", F.array_compact(F.array(said, gap)).alias("p")).groupBy("session_id").agg(F.array_join(F.flatten(parts), "\n\n---\n\n").alias("whole"))
    return by.select("session_id", F.when(F.octet_length("whole") > total, T.utf8_truncate(F.col("whole"), total)).otherwise(F.col("whole")).alias("transcript"))


def recent(rows: DataFrame, keep: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(keep)


INJECTION = "timestamp string, prompt string, project string, session_id string, chunk_ids array<string>"
LOG_LINES, LOG_BYTES = 1000, 256 * 1024


def injections(spark: SparkSession, path: str) -> DataFrame:
    """What was injected, from a log of JSON lines; lines that can't be read are passed over."""
    return spark.read.schema(INJECTION).option("mode", "DROPMALFORMED").json(path)


def log_injections(rows: DataFrame, path: str) -> None:
    rows.select("timestamp", "prompt", "project", "session_id", "chunk_ids").write.mode("append").json(path)


def pruned_injections(spark: SparkSession, path: str, keep: int = LOG_LINES, least: int = LOG_BYTES) -> DataFrame:
    """The log without all but its newest lines, once it takes `least` bytes; a smaller one as it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    rows = injections(spark, path)
    return recent(rows, keep, F.desc("timestamp"), F.col("session_id"), F.col("prompt")) if size >= least else rows


def prune_injections(spark: SparkSession, path: str, keep: int = LOG_LINES, least: int = LOG_BYTES) -> int:
    """Replaces a log that takes `least` bytes by its newest lines; how many went, those that couldn't be read included.

    Only files that are there at the beginning are replaced, so lines that others append meanwhile stay. The newest lines are written
    aside, a marker with the names of the replaced files is put down by a rename, and then these go and the new file comes in. A job that dies before
    the marker leaves the log as it is; of one that dies after it the next prune does the rest.
    """
    _finish_prune(spark, path)
    store, at = ingest._store(spark, path)
    if not store.exists(at) or store.getContentSummary(at).getLength() < least:
        return 0
    names = sorted(n for f in store.listStatus(at) if f.isFile() and not (n := f.getPath().getName()).startswith(("_", ".")))
    if not names:
        return 0
    files, tag = [f"{path}/{n}" for n in names], uuid.uuid4().hex
    had = spark.read.text(files).where(F.trim("value") != "").count()
    rows = spark.read.schema(INJECTION).option("mode", "DROPMALFORMED").json(files)
    newest = recent(rows, keep, F.desc("timestamp"), F.col("session_id"), F.col("prompt"))
    newest.coalesce(1).write.json(f"{path}/.pruned-{tag}")
    mark = ingest._store(spark, f"{path}/.mark-{tag}")[1]
    out = store.create(mark, True)
    out.write(bytearray("\n".join(names), "utf-8"))
    out.close()
    kept = spark.read.text(f"{path}/.pruned-{tag}/part-*").count()
    if not store.rename(mark, ingest._store(spark, f"{path}/_pruned-{tag}")[1]):
        raise OSError(f"the marker in {path} couldn't be put down")
    _finish_prune(spark, path)
    return had - kept


def _finish_prune(spark: SparkSession, path: str) -> None:
    """What a marker says is still to do; done twice it is as done once."""
    store, at = ingest._store(spark, path)
    for mark in store.globStatus(ingest._store(spark, f"{path}/_pruned-*")[1]) or []:
        stream = store.open(mark.getPath())
        names = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        stream.close()
        for name in names:
            store.delete(ingest._store(spark, f"{path}/{name}")[1], False)
        staged = ingest._store(spark, f"{path}/.pruned-{mark.getPath().getName().removeprefix('_pruned-')}")[1]
        for f in store.globStatus(ingest._store(spark, f"{staged}/part-*")[1]) or []:
            if not store.rename(f.getPath(), ingest._store(spark, f"{path}/{f.getPath().getName()}")[1]):
                raise OSError(f"{f.getPath()} couldn't be moved")
        store.delete(staged, True)
        store.delete(mark.getPath(), False)
