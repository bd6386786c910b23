"""The readers by name: what each one's files look like, which of them a folder holds, and all their sessions in one table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.sources import keyvalue, logs


@dataclass(frozen=True)
class Reader:
    """read(spark, path, since): sessions of what changed after `since` (seconds), or of everything."""

    name: str
    pattern: str
    read: Callable[[SparkSession, str, float | None], DataFrame]

    def detect(self, spark: SparkSession, path: str) -> bool:
        """Whether a folder holds a file of this kind; only names are looked at."""
        found = spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).option("recursiveFileLookup", "true").load(path)
        return not found.select("path").limit(1).isEmpty()


def _later(sessions: DataFrame, since: float | None) -> DataFrame:
    """For readers whose files keep many sessions: those that ended later, or don't say when."""
    if since is None:
        return sessions
    ended = F.coalesce(F.when(F.col("ended_at") != "", F.col("ended_at")), F.col("started_at"), F.lit(""))
    return sessions.where((ended == "") | (F.try_to_timestamp(F.regexp_replace(ended, "Z$", "")) > F.timestamp_seconds(F.lit(since))))


READERS: dict[str, Reader] = {}


def register(reader: Reader) -> None:
    READERS[reader.name] = reader


register(Reader("session-jsonl", "*.jsonl", logs.session_jsonl))
register(Reader("event-jsonl", "*.jsonl", logs.event_jsonl))
register(Reader("prompt-history", "*.jsonl", logs.prompt_history))
register(Reader("chat-markdown", "*.md", lambda spark, path, since: _later(logs.chat_markdown(spark, path), since)))
register(Reader("composer", "*.vscdb", lambda spark, path, since: _later(keyvalue.composer_sessions(spark, path), since)))


def sessions(spark: SparkSession, paths: dict[str, str], since: float | None = None) -> DataFrame:
    """The sessions of several readers (name: path) together."""
    if unknown := sorted(set(paths) - set(READERS)):
        raise ValueError(f"no reader is called {', '.join(unknown)}; there are {', '.join(sorted(READERS))}")
    if not paths:
        raise ValueError("no paths given")
    return reduce(DataFrame.unionByName, [READERS[name].read(spark, path, since) for name, path in paths.items()])
