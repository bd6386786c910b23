"""Chats kept in SQLite key-value databases, as a Python data source.

    spark.dataSource.register(KeyValueSource)
    spark.read.format("sqlite_kv").option("path", file).option("table", "cursorDiskKV").option("prefix", "composerData:").load()

One partition a database file; rows are streamed in key order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorekiln.functions import text as T
from lorekiln.operators import tables


def databases(path: str) -> list[str]:
    """The files that a path (several parted by commas) names; of a folder those of chats below it, which lie in globalStorage."""
    import os

    out = []
    for p in filter(None, path.split(",")):
        if os.path.isdir(p):
            out += sorted(os.path.join(d, f) for d, _, names in os.walk(p) if os.path.basename(d) == "globalStorage" for f in names if f.endswith(".vscdb"))
        else:
            out.append(p)
    return out


class KeyValueSource(DataSource):
    """Options: path (files parted by commas), table, prefix of keys, min_length of values (longer ones are read)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return "path string, key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return KeyValueReader(dict(self.options))


class KeyValueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(p) for p in databases(self.options["path"])]

    def read(self, partition):
        import contextlib
        import re
        import sqlite3

        table = self.options.get("table", "cursorDiskKV")
        if not re.fullmatch(r"\w+", table):
            raise ValueError(f"{table!r} is no table's name")
        prefix, least = self.options.get("prefix", ""), int(self.options.get("min_length", "0"))
        with contextlib.closing(sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True)) as db:
            query = f"SELECT key, CAST(value AS TEXT) FROM {table} WHERE substr(key, 1, ?) = ? AND length(value) > ? ORDER BY key"
            for key, value in db.execute(query, (len(prefix), prefix, least)):
                yield partition.value, key, value


class WorkspaceSource(DataSource):
    """Which project a chat belongs to, as the workspaces beside a database of chats tell. Option: path, as above."""

    @classmethod
    def name(cls) -> str:
        return "workspace_projects"

    def schema(self) -> str:
        return "path string, workspace string, composer_id string, project string"

    def reader(self, schema) -> DataSourceReader:
        return WorkspaceReader(dict(self.options))


class WorkspaceReader(DataSourceReader):
    """A partition a workspace. One that can't be read, has no folder or no chats tells nothing."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        import os

        out = []
        for path in databases(self.options["path"]):
            folder = os.path.join(os.path.dirname(os.path.dirname(path)), "workspaceStorage")
            if os.path.isdir(folder):
                out += [InputPartition((path, e.path)) for e in sorted(os.scandir(folder), key=lambda e: e.name) if e.is_dir()]
        return out

    def read(self, partition):
        if partition is None:  # there is no workspace
            return
        import contextlib
        import json
        import os
        import sqlite3

        path, workspace = partition.value
        try:
            with open(os.path.join(workspace, "workspace.json"), encoding="utf-8") as f:
                uri = json.load(f).get("folder", "")
            project = os.path.basename(uri.replace("file://", "").rstrip("/"))
            at = os.path.join(workspace, "state.vscdb")
            if not project or not os.path.exists(at):
                return
            with contextlib.closing(sqlite3.connect(f"file:{at}?mode=ro", uri=True)) as db:
                value = db.execute("SELECT value FROM ItemTable WHERE key = 'composer.composerData'").fetchone()
            chats = json.loads(value[0]).get("allComposers", []) if value and value[0] else []
            told = [c["composerId"] for c in chats if isinstance(c, dict) and isinstance(c.get("composerId"), str) and c["composerId"]]
        except (ValueError, AttributeError, TypeError, sqlite3.Error, OSError):
            return
        for chat in told:
            yield path, workspace, chat, project


def workspace_projects(spark: SparkSession, path: str) -> DataFrame:
    """path (of the database), composer_id, project; of several workspaces that know a chat the last by name counts."""
    if not any(databases(path)):
        return spark.createDataFrame([], "path string, composer_id string, project string")
    spark.dataSource.register(WorkspaceSource)
    rows = spark.read.format("workspace_projects").option("path", path).load()
    return rows.groupBy("path", "composer_id").agg(F.max_by("project", "workspace").alias("project"))


def composer_sessions(spark: SparkSession, path: str, projects: DataFrame | None = None, source: str = "composer") -> DataFrame:
    """Sessions of databases. Entries without messages are left out.

    projects: composer_id, project; if it isn't given, what the workspaces beside each database tell. That is written first: its size decides
    whether it is broadcast.
    """
    spark.dataSource.register(KeyValueSource)
    raw = spark.read.format("sqlite_kv").option("path", path).option("table", "cursorDiskKV").option("prefix", "composerData:").option("min_length", "100").load()
    kind = "composerId string, name string, createdAt bigint, lastUpdatedAt bigint, conversation array<struct<type:int,text:string,timestamp:bigint>>"
    rows = raw.select("path", "key", F.from_json("value", kind).alias("j"), F.regexp_extract("value", r'"(?:fsPath|uri)"\s*:\s*"([^"]+)"', 1).alias("uri")).where("j.conversation IS NOT NULL")
    told = F.filter("j.conversation", lambda m: m["type"].isin(1, 2) & (T.strip(F.coalesce(m["text"], F.lit(""))) != ""))
    created = F.col("j.createdAt")
    turns = F.transform(told, lambda m, i: F.struct(i.cast("bigint").alias("n"), F.when(m["type"] == 1, "human").otherwise("assistant").alias("role"), m["text"].alias("content"), T.epoch_ms_iso(F.coalesce(m["timestamp"], created)).alias("timestamp"), F.array().cast("array<string>").alias("tools")))
    rows = rows.select("path", F.coalesce("j.composerId", F.regexp_replace("key", "^composerData:", "")).alias("session_id"), F.col("j.name").alias("summary"), T.epoch_ms_iso(created).alias("started_at"), T.epoch_ms_iso(F.coalesce("j.lastUpdatedAt", created)).alias("ended_at"), F.nullif("uri", F.lit("")).alias("uri"), turns.alias("exchanges")).where("size(exchanges) > 0")
    if projects is not None:
        rows = rows.join(projects.select(F.col("composer_id").alias("session_id"), "project"), "session_id", "left")
    else:
        known = tables.kept(workspace_projects(spark, path), "projects")
        rows = rows.join(known.withColumnRenamed("composer_id", "session_id"), ["path", "session_id"], "left")
    return rows.select(
        "session_id", F.lit(source).alias("source"), F.coalesce("project", T.basename(F.col("uri")), F.lit("unknown")).alias("project"), F.lit(None).cast("string").alias("git_branch"), "started_at", "ended_at",
        F.lit("").alias("working_directory"), "summary", F.array().cast("array<string>").alias("files"), "exchanges",
    )
