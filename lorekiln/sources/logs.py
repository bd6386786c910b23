"""JSON-lines and markdown logs. Lines are read in parallel; a file's own order is kept by line number.

`since` (epoch seconds) leaves out files that haven't changed after it. JSON lines come by `lines`: a large log is cut into byte ranges,
each a task of its own, and unchanged files are left out when the folder is listed, so that they are never opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.functions import patterns as P
from lorekiln.functions import text as T
from lorekiln.sources.parsing import SESSION, distinct_user_turns, first_said, project_of_slug

_TURN = "struct<n:bigint,role:string,content:string,timestamp:string,tools:array<string>>"


def files(spark: SparkSession, path: str, pattern: str, since: float | None = None, recursive: bool = True) -> DataFrame:
    """path, mtime, text of whole files. A log is one row: its lines are ordered and none is larger than a session."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(path).select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(F.col("mtime").cast("double") > since) if since is not None else rows


def lines(spark: SparkSession, path: str, pattern: str, since: float | None = None, without: str | None = None, recursive: bool = True) -> DataFrame:
    """path, mtime, block, place, raw: the lines of logs, which are cut into byte ranges of spark.sql.files.maxPartitionBytes at line ends.

    block is where a line's range begins in its file, place grows along a range: (block, place) is the order of a file's lines, but no
    count of them, for which see `numbered`. Files whose path has `without` in it are left out. Invalid UTF-8 is replaced. Empty
    files have no lines, and none follows the last line end.
    """
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.text(path)
    if since is not None:
        rows = rows.where(F.col("_metadata.file_modification_time") > F.timestamp_seconds(F.lit(since)))
    if without:
        rows = rows.where(~F.contains(F.col("_metadata.file_path"), F.lit(without)))
    # the path is that of a URI: percent signs stand for what isn't allowed there, a plus for itself
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return rows.select(
        name.alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.make_valid_utf8("value").alias("raw")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """path, mtime, line, raw: lines with their numbers in the file, from 0. Lines of each range are counted first, prefix sums give where a range begins; the counts (one row a range) are joined."""
    ranges = rows.groupBy("path", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = ranges.select("path", "block", (before - F.col("first")).alias("shift"))
    return rows.join(begins, ["path", "block"]).select("path", "mtime", (F.col("place") + F.col("shift")).alias("line"), "raw")


def _in_order(turns: str | Column) -> Column:
    """Turns (n, role, content, timestamp, tools), sorted by n and numbered from 0."""
    return F.transform(F.array_sort(turns), lambda x, i: F.struct(i.cast("bigint").alias("n"), x["role"].alias("role"), x["content"].alias("content"), x["timestamp"].alias("timestamp"), x["tools"].alias("tools"))).cast(f"array<{_TURN}>")


def named_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for files by name on folders that all executors see. Spark's readers pass over names that begin with a dot."""

    def each(batches):
        import os

        import pandas as pd

        for b in batches:
            rows = [(p, pd.Timestamp(os.path.getmtime(p), unit="s").floor("us"), open(p, encoding="utf-8", errors="replace").read()) for p in b["path"]]  # noqa: SIM115
            yield pd.DataFrame(rows, columns=["path", "mtime", "text"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(each, "path string, mtime timestamp, text string")


def numbered_lines(rows: DataFrame, ends: str = "\n") -> DataFrame:
    return rows.select("path", "mtime", F.posexplode(F.split("text", ends)).alias("line", "raw"))


def _json(c: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(c) if isinstance(c, str) else c, path, kind)


def _blocks(c: Column) -> Column:
    """A message's content as an array of blocks; null if it is a string."""
    return F.from_json(_json(c, "$.message.content"), "array<struct<type:string,text:string,name:string,input:string>>")


def _session_lines(rows: DataFrame) -> DataFrame:
    """path, line, and what a line (raw) of a session log says."""
    rows = rows.where(F.trim("raw") != "").select("path", "line", F.try_parse_json("raw").alias("v")).where("v IS NOT NULL")
    got = lambda p: F.coalesce(_json("v", p), F.lit(""))
    rows = rows.select("path", "line", got("$.type").alias("type"), got("$.timestamp").alias("timestamp"), got("$.sessionId").alias("sid"), got("$.cwd").alias("cwd"), got("$.gitBranch").alias("branch"), got("$.message.content").alias("plain"), _blocks(F.col("v")).alias("blocks"))
    text = F.when(F.col("blocks").isNotNull(), F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")).otherwise(F.col("plain"))
    used = F.filter("blocks", lambda b: b["type"] == "tool_use")
    rows = rows.withColumns({"text": text, "tools": F.coalesce(F.transform(used, lambda b: F.coalesce(b["name"], F.lit("unknown"))), F.array().cast("array<string>")), "touched": F.filter(F.transform(F.filter(used, lambda b: b["name"].isin("Read", "Edit", "Write")), lambda b: F.get_json_object(b["input"], "$.file_path")), lambda x: x.isNotNull())})
    content = F.when((T.strip(F.col("text")) == "") & (F.size("tools") > 0), F.concat(F.lit("[Used tools: "), F.array_join("tools", ", "), F.lit("]"))).otherwise(F.col("text"))
    role = F.when(F.col("type") == "user", "human").when(F.col("type") == "assistant", "assistant")
    return rows.select("path", "line", "timestamp", "sid", "cwd", "branch", "tools", "touched", F.when(T.strip(content) != "", role).alias("role"), content.alias("content"))


def _session_heads() -> list[Column]:
    stamped = F.col("timestamp") != ""
    return [
        first_said(F.col("sid"), F.col("line")).alias("sid"), first_said(F.col("cwd"), F.col("line")).alias("cwd"), first_said(F.col("branch"), F.col("line")).alias("git_branch"), first_said(F.col("timestamp"), F.col("line")).alias("started_at"),
        F.max_by(F.when(stamped, F.col("timestamp")), F.when(stamped, F.col("line"))).alias("ended_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("touched")))).alias("files"),
    ]


def _session_columns(by: DataFrame, source: str) -> DataFrame:
    slug = F.element_at(F.split("path", "/"), -2)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    return by.withColumns({
        "session_id": F.coalesce("sid", stem), "source": F.lit(source), "project": F.coalesce(T.basename(F.col("cwd")), project_of_slug(slug)), "started_at": F.coalesce("started_at", F.lit("")),
        "ended_at": F.coalesce("ended_at", F.lit("")), "working_directory": F.coalesce("cwd", F.lit("")), "summary": F.lit(None).cast("string"),
    })


def session_jsonl(spark: SparkSession, path: str, since: float | None = None, source: str = "session-jsonl") -> DataFrame:
    """One file a session; lines are user and assistant messages, others only lend their fields; bad lines are skipped. Logs too long for an array of their turns: `session_turns`."""
    rows = lines(spark, path, "*.jsonl", since, "subagents")
    rows = _session_lines(rows.select("path", F.struct("block", "place").alias("line"), "raw"))
    turn = F.when(F.col("role").isNotNull(), F.struct(F.col("line").alias("n"), "role", "content", "timestamp", "tools"))
    by = rows.groupBy("path").agg(*_session_heads(), F.collect_list(turn).alias("exchanges")).where(F.size("exchanges") > 0)
    return _session_columns(by, source).select(*SESSION[:-1], _in_order("exchanges").alias("exchanges"))


def session_turns(spark: SparkSession, path: str, since: float | None = None, source: str = "session-jsonl") -> DataFrame:
    """The same logs a row a turn, as ingest takes them, with n the number of the line; no session's texts meet in one row.

    What is known of a session (a row of short fields, and its distinct files) is gathered and joined to its turns.
    """
    rows = _session_lines(numbered(lines(spark, path, "*.jsonl", since, "subagents")))
    heads = _session_columns(rows.groupBy("path").agg(*_session_heads()), source)
    return heads.join(rows.where("role IS NOT NULL").select("path", F.col("line").alias("n"), "role", "content", "timestamp", "tools"), "path").select(
        "session_id", "source", "project", "git_branch", "started_at", "files", "n", "role", "content", "timestamp", "tools"
    )


def event_jsonl(spark: SparkSession, path: str, since: float | None = None, source: str = "event-jsonl") -> DataFrame:
    """One file a session; messages come as response items or as event messages, tool calls as events of their own."""
    rows = lines(spark, path, "*.jsonl", since).where(F.trim("raw") != "").select("path", F.struct("block", "place").alias("n"), F.try_parse_json("raw").alias("v")).where("v IS NOT NULL")
    got = lambda p: F.coalesce(_json("v", p), F.lit(""))
    kind, inner = got("$.type"), got("$.payload.type")
    parts = F.from_json(_json("v", "$.payload.content"), "array<struct<type:string,text:string>>")
    said = F.array_join(F.transform(F.filter(parts, lambda x: F.coalesce(x["text"], F.lit("")) != ""), lambda x: x["text"]), "\n")
    role = F.when((kind == "response_item") & (inner == "message"), F.when(got("$.payload.role") == "user", "human").when(got("$.payload.role") == "assistant", "assistant")).when((kind == "event_msg") & (inner == "user_message"), "human").when((kind == "event_msg") & (inner == "agent_message"), "assistant")
    call = (kind == "function_call") | ((kind == "response_item") & (inner == "function_call"))
    content = F.when(kind == "response_item", F.coalesce(said, F.lit(""))).otherwise(got("$.payload.message"))
    rows = rows.select("path", "n", kind.alias("kind"), role.alias("role"), T.strip(content).alias("content"), got("$.timestamp").alias("timestamp"), F.when(call, F.when(got("$.payload.name") != "", got("$.payload.name")).otherwise("unknown")).alias("tool"), got("$.payload.id").alias("sid"), got("$.payload.cwd").alias("cwd"), got("$.payload.git.branch").alias("branch"))
    heads = rows.groupBy("path").agg(*[first_said(F.when(F.col("kind") == "session_meta", F.col(c)).otherwise(""), F.col("n")).alias(c) for c in ("sid", "cwd", "branch")], first_said(F.col("timestamp"), F.col("n")).alias("started_at"), F.max_by(F.when(F.col("timestamp") != "", F.col("timestamp")), F.when(F.col("timestamp") != "", F.col("n"))).alias("ended_at"))
    turns = rows.where("role IS NOT NULL AND content <> ''").where(~F.col("content").startswith("<environment_context>"))
    turns = distinct_user_turns(turns, "path").select("path", "n", "role", "content", "timestamp", F.lit(None).cast("string").alias("tool"))
    calls = rows.where("tool IS NOT NULL").select("path", "n", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"), "timestamp", "tool")
    owner = F.last(F.when(F.col("role") == "assistant", F.col("n")), ignorenulls=True).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    both = turns.unionByName(calls).withColumn("at", F.when(F.col("tool").isNotNull(), owner).otherwise(F.col("n"))).where("at IS NOT NULL")
    one = both.groupBy("path", "at").agg(F.max("role").alias("role"), F.max("content").alias("content"), F.min_by("timestamp", "n").alias("timestamp"), F.transform(F.array_sort(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("n", "tool")))), lambda x: x["tool"]).alias("tools"))
    by = one.groupBy("path").agg(_in_order(F.collect_list(F.struct(F.col("at").alias("n"), "role", "content", "timestamp", "tools"))).alias("exchanges")).join(heads, "path")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    return by.select(
        F.coalesce("sid", stem).alias("session_id"), F.lit(source).alias("source"), F.coalesce(T.basename(F.col("cwd")), F.lit("unknown")).alias("project"), F.col("branch").alias("git_branch"), F.coalesce("started_at", F.lit("")).alias("started_at"),
        F.coalesce("ended_at", F.lit("")).alias("ended_at"), F.coalesce("cwd", F.lit("")).alias("working_directory"), F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("files"), "exchanges",
    )


def arguments(c: Column) -> Column:
    """A call's arguments as JSON text: an object as it is, {"raw": ...} for what can't be parsed, {} for anything else."""
    parsed = F.try_parse_json(c)
    return F.when(parsed.isNull(), F.to_json(F.struct(c.alias("raw")))).when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise("{}")


def prompt_history(spark: SparkSession, path: str, since: float | None = None, source: str = "prompt-history") -> DataFrame:
    """Prompts alone: a session a file, at the file's time."""
    rows = lines(spark, path, "*.jsonl", since).select("path", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.struct("block", "place").alias("n"), T.strip(F.get_json_object("raw", "$.input")).alias("c")).where("c <> ''")
    turn = F.struct("n", F.lit("human").alias("role"), F.col("c").alias("content"), F.col("t").alias("timestamp"), F.array().cast("array<string>").alias("tools"))
    by = rows.groupBy("path", "t").agg(_in_order(F.collect_list(turn)).alias("exchanges"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    return by.select(
        F.concat(F.lit("prompts-"), stem).alias("session_id"), F.lit(source).alias("source"), F.lit("general").alias("project"), F.lit(None).cast("string").alias("git_branch"), F.col("t").alias("started_at"), F.col("t").alias("ended_at"),
        F.lit("").alias("working_directory"), F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("files"), "exchanges",
    )


HEADER = r"^# (?:\w+) chat started at (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\s*$"
EDIT = r"^>\s*Applied edit to (.+?)\s*$"


def chat_paths(root: str, name: str, most: int = 6) -> list[str]:
    """Chat logs below a folder, not deeper than `most`, past folders that hold none."""
    import os

    out, root = [], os.path.abspath(root)
    for folder, below, names in os.walk(root):
        if folder[len(root) :].count(os.sep) >= most:
            below[:] = []
            continue
        below[:] = sorted(x for x in below if x not in P.SKIPPED_FOLDERS and not x.startswith("."))
        if name in names:
            out.append(os.path.join(folder, name))
    return out


def chat_markdown(spark: SparkSession, path: str | list[str], name: str = "*.md", source: str = "chat-markdown") -> DataFrame:
    """Markdown chats: #### opens the user's lines, > tells of tools, the rest is the assistant's.

    Islands of lines of one speaker are numbered by running counts; an edit notice goes to the assistant's
    turn that is open, or makes an empty one.
    """
    if isinstance(path, str):
        rows = files(spark, path, name)
    else:
        rows = named_files(spark, path)
    rows = numbered_lines(rows, P.LINE_ENDS).drop("mtime")
    w = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("head", F.nullif(F.regexp_extract("raw", HEADER, 1), F.lit(""))).withColumn("s", F.count("head").over(w)).where("s > 0")
    time = F.coalesce(F.date_format(F.try_to_timestamp("head", F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("head"))
    rows = rows.withColumn("timestamp", F.last(time, ignorenulls=True).over(w)).where("head IS NULL")
    user = F.col("raw").startswith("#### ") | (F.col("raw") == "####")
    notice = F.col("raw").startswith(">")
    edit = F.nullif(T.strip(F.regexp_extract("raw", EDIT, 1)), F.lit(""))
    rows = rows.withColumns({"kind": F.when(user, "human").when(notice, "notice").otherwise("assistant"), "edit": F.when(notice, edit), "body": F.when(user, F.substring("raw", 6, 1 << 30)).otherwise(F.col("raw"))})
    # an assistant's turn is open from its first line to the user's next; blank lines alone open none
    rows = rows.where("kind <> 'notice' OR edit IS NOT NULL")
    v = Window.partitionBy("path", "s").orderBy("line")
    change = F.when(F.col("kind") == "human", F.lag("kind").over(v).eqNullSafe("human") == F.lit(False)).otherwise(F.lag("kind", 1, "human").over(v) == "human")
    after_edit = (F.col("kind") == "assistant") & (F.lag("kind").over(v) == "notice")
    rows = rows.withColumn("turn", F.sum((change | after_edit).cast("int")).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    turns = rows.groupBy("path", "s", "turn", "timestamp").agg(
        F.min("line").cast("bigint").alias("n"), F.max(F.when(F.col("kind") == "human", "human").otherwise("assistant")).alias("role"),
        T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "notice", F.struct("line", "body")))), lambda x: x["body"]), "\n")).alias("content"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("edit").isNotNull(), F.struct("line", "edit")))), lambda x: x["edit"]).alias("edits"),
    ).where("content <> '' OR size(edits) > 0 OR role = 'human'")
    turn = F.struct("n", "role", "content", "timestamp", F.transform("edits", lambda x: F.lit("edit_file")).alias("tools"))
    by = turns.groupBy("path").agg(F.array_sort(F.collect_list(turn)).alias("exchanges"), F.min_by("timestamp", "s").alias("started_at"), F.max_by("timestamp", "s").alias("ended_at"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "edits"))), lambda x: x["edits"]))).alias("files"))
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return by.select(
        F.concat(F.lit("chat-"), F.substring(F.sha1(F.concat_ws("|", "path", "ended_at").cast("binary")), 1, 16)).alias("session_id"), F.lit(source).alias("source"), T.basename(folder).alias("project"), F.lit(None).cast("string").alias("git_branch"), "started_at", "ended_at",
        F.regexp_replace(folder, "^file:", "").alias("working_directory"), F.lit(None).cast("string").alias("summary"), "files", F.col("exchanges").cast(f"array<{_TURN}>").alias("exchanges"),
    )
