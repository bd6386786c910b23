"""Rows to files: a file a row (notes), or one document of many parts (exports)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.operators import tables

STAGED = ".staged"


def _place(root: str, path: str) -> str:
    """Where a file goes; an error if that isn't below the folder."""
    import os

    at = os.path.normpath(os.path.join(root, path))
    if os.path.isabs(path) or not at.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"{path!r} isn't below the folder")
    return at


def _stage(root: str, job: str, mode: int):
    def stage(batches):
        import os

        import pandas as pd

        folder = os.path.join(root, STAGED, job, uuid.uuid4().hex)  # an attempt's own: one that is run again meets nothing of the first
        os.makedirs(folder, mode=0o700)
        n = 0
        for b in batches:
            staged = []
            for path, content in zip(b["path"], b["content"], strict=True):
                _place(root, path)
                at = os.path.join(folder, str(n))
                n += 1
                fd = os.open(at, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode)
                with os.fdopen(fd, "wb") as f:
                    os.fchmod(fd, mode)
                    f.write(content.encode("utf-8", "surrogatepass"))
                    f.flush()
                    os.fsync(fd)
                staged.append(at)
            yield pd.DataFrame({"path": b["path"], "staged": staged})

    return stage


def _move(root: str):
    def move(batches):
        import os

        import pandas as pd

        for b in batches:
            for path, staged in zip(b["path"], b["staged"], strict=True):
                at = _place(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                try:
                    os.replace(staged, at)
                except FileNotFoundError:
                    if not os.path.exists(at):  # else an attempt that was lost has moved it
                        raise
            yield pd.DataFrame({"n": [len(b)]})

    return move


def put_files(rows: DataFrame, root: str, key: str, mode: int = 0o600) -> dict[str, int]:
    """Writes a file for each path (below root) of rows: path, content, key. {"written", "replaced"}: files, and rows that gave way to another of their path.

    root is a folder that all executors see, with an atomic rename. All files are staged before the first takes its place by a rename, so a
    job that fails while it writes leaves none; one that is run again overwrites its files by the same ones. Of equal paths the row of
    the largest key, then content, stays. Null paths have no file, null contents an empty one. Names begin below root; a path that leads out of it
    is an error. Both steps are tasks of Spark; only counts come to the driver.
    """
    import os
    import shutil

    if not os.path.isabs(root):
        raise ValueError("the folder's path must be absolute")
    job = uuid.uuid4().hex
    rows = rows.where("path IS NOT NULL").select("path", F.coalesce("content", F.lit("")).alias("content"), key)
    best = rows.groupBy("path").agg(F.max_by("content", F.struct(key, "content")).alias("content"), F.count("*").alias("n"))
    counts = tables.kept(best, "files")
    try:
        staged = tables.kept(counts.select("path", "content").mapInPandas(_stage(root, job, mode), "path string, staged string"), "staged")
        moved = staged.mapInPandas(_move(root), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        shutil.rmtree(os.path.join(root, STAGED, job), ignore_errors=True)
        if os.path.isdir(os.path.join(root, STAGED)) and not os.listdir(os.path.join(root, STAGED)):
            os.rmdir(os.path.join(root, STAGED))
    return {"written": moved, "replaced": counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] - moved}


def put_notes(notes: DataFrame, root: str) -> dict[str, int]:
    """Notes (session_id, path, note; `surfaces.session_notes`) as files that their owner alone reads. Of sessions that share a path the one of the largest id stays."""
    return put_files(notes.select("path", F.col("note").alias("content"), "session_id"), root, "session_id")


def _ordered(rows: DataFrame, text: Column, order: list[str]) -> DataFrame:
    return rows.select(*order, text.alias("value")).repartitionByRange(*order).sortWithinPartitions(*order)


def export_json(chunks: DataFrame, path: str, project: str | None = None) -> None:
    """The chunks (of a project, if one is named) as a JSON array, in parts: put together in the order of their names they are one document.

    An element a line: id, content, and the other columns as metadata; ordered by time, id, which no two rows share. Without rows the document is [].
    """
    rows = chunks.where(F.col("project") == project) if project else chunks
    told = [c for c in ("session_id", "project", "source", "git_branch", "timestamp", "chunk_index") if c in rows.columns]
    order = ["timestamp", "id"]
    item = F.to_json(F.struct("id", "content", F.struct(*told).alias("metadata")), {"ignoreNullFields": "false"})
    ends = rows.agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b"), F.count("*").alias("n")).first()
    if not ends["n"]:
        chunks.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    here = F.struct(*order)
    like = lambda end: here.eqNullSafe(F.struct(*[F.lit(end[c]).alias(c) for c in order]))
    lines = F.concat(F.when(like(ends["a"]), "[").otherwise(","), item, F.when(like(ends["b"]), "]").otherwise(""))
    _ordered(rows, lines, order).select("value").write.mode("overwrite").text(path)


def export_markdown(chunks: DataFrame, path: str, project: str | None = None) -> None:
    """The same as a Markdown document: a title and the number of chunks, then project, day, source and text of each."""
    rows = chunks.where(F.col("project") == project) if project else chunks
    known = lambda c: F.coalesce(F.col(c), F.lit("?"))
    block = F.concat(F.lit("## "), known("project"), F.lit(" — "), F.substring(known("timestamp"), 1, 10), F.lit("\n*Source: "), known("source"), F.lit("*\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n---\n"))
    order = ["first", "timestamp", "id"]
    head = rows.agg(F.count("*").alias("n")).select(F.lit(0).alias("first"), F.lit("").alias("timestamp"), F.lit("").alias("id"), F.concat(F.lit("# Memory Export\n\nTotal chunks: "), F.col("n").cast("string"), F.lit("\n")).alias("block"))
    both = head.unionByName(rows.select(F.lit(1).alias("first"), "timestamp", "id", block.alias("block")))
    _ordered(both, F.col("block"), order).select("value").write.mode("overwrite").text(path)
