"""What callers are shown: full search, project context, cross reference, session start, prompt and file context, session notes, summaries.

Each composes `search`, `lifecycle` and `mining`; the vector of the query's text is the caller's. What is gathered into one text are the
few hits of a search, the parts of one session, or a list cut to its newest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.operators import lifecycle, mining, search

MIN_RELEVANCE = 0.25
#: Prompts that ask for nothing.
INTERJECTIONS = ("yes", "no", "ok", "okay", "continue", "go", "do it", "please", "yep", "nope", "sure", "cancel", "stop")
LEAST_PROMPT = 8


def _capped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def shown(hits: DataFrame, rank: str, most: int = 600) -> DataFrame:
    """id, place, relevance (percent; null without a distance), meta, text of hits that don't repeat each other, best first."""
    kept = search.deduped(hits, [F.desc(rank), F.col("id")])
    place = F.row_number().over(Window.orderBy(F.desc(rank), "id"))  # a search's hits: fifty at most
    meta = T.compact_metadata(F.col("project"), F.col("source"), F.col("git_branch"), F.col("timestamp"))
    return kept.select("id", place.alias("place"), F.round((1 - F.col("distance")) * 100).cast("int").alias("relevance"), meta.alias("meta"), _capped(T.optimized(F.col("content")), most).alias("text"))


def page(found: DataFrame) -> DataFrame:
    """One text of what `shown` gives."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce(F.concat(F.col("relevance").cast("string"), F.lit("%")), F.lit("?")), F.lit(" — "), F.col("meta"), F.lit("\n"), F.col("text"), F.lit("\n"))
    one = found.select("place", line.alias("line")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
    return one.select(F.when(F.col("n") == 0, "No matching results found.").otherwise(F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" results:\n\n"), F.array_join("lines", "\n"))).alias("page"))


def full(rows: DataFrame, query: str, vector: list[float], k: int = 5, index: str | None = None, **filters: str | None) -> DataFrame:
    query, _, _, k = search.checked(query, filters.get("project") or "", filters.get("source") or "", k)
    return shown(search.hybrid(rows, query, vector, k, min_relevance=MIN_RELEVANCE, index=index, **filters), "score")


def project_context(rows: DataFrame, project: str, vector: list[float], now: str, topic: str = "", index: str | None = None) -> DataFrame:
    """What was done lately in a project, or about a topic there."""
    query, project, _, _ = search.checked(topic or f"recent work on {project}", project)
    return shown(search.search(rows, query, vector, k=8, min_relevance=MIN_RELEVANCE, now=now, index=index, project=project), "decayed")


def cross_reference(rows: DataFrame, query: str, vector: list[float], index: str | None = None) -> DataFrame:
    """A search over all projects and sources."""
    return shown(search.hybrid(rows, search.checked(query)[0], vector, 10, min_relevance=MIN_RELEVANCE, index=index), "score")


def terminal(rows: DataFrame, query: str, vector: list[float], k: int = 5, most: int = 400, lines: int = 8, index: str | None = None, **filters: str | None) -> DataFrame:
    """id, place, text: the first lines of the first characters of each hit."""
    hits = search.hybrid(rows, query, vector, k, index=index, **filters)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return hits.select("id", place.alias("place"), F.array_join(F.slice(F.split(F.substring("content", 1, most), "\n"), 1, lines), "\n").alias("text"))


def session_start(rows: DataFrame, cwd: str, vector: list[float], now: str, index: str | None = None) -> DataFrame:
    """day, snippet: recent activity in the project of a working folder; none without a folder."""
    project = _last(cwd)
    if not project:
        return rows.select(F.lit("").alias("day"), F.lit("").alias("snippet")).where(F.lit(False))
    hits = search.search(rows, f"recent work on {project}", vector, k=3, min_relevance=0.30, now=now, index=index, project=project)
    return hits.orderBy(F.desc("decayed"), "id").select(F.substring("timestamp", 1, 10).alias("day"), T.snippet(F.col("content"), 180, "...").alias("snippet"))


def asks(prompt: str) -> bool:
    """Whether a prompt is worth a search."""
    prompt = prompt.strip()
    return len(prompt) >= LEAST_PROMPT and prompt.lower() not in INTERJECTIONS


def prompt_context(rows: DataFrame, prompt: str, cwd: str, session: str, vector: list[float], index: str | None = None) -> DataFrame:
    """id, line: up to three hits of the folder's project, none from the session that asks; none for a prompt that asks for nothing."""
    if not asks(prompt):
        return rows.select("id", F.lit("").alias("line")).where(F.lit(False))
    hits = search.context(rows, prompt.strip(), vector, session, index=index, project=_last(cwd))
    head = F.concat(F.lit("- ["), F.coalesce("project", F.lit("?")), F.lit(" · "), F.coalesce("source", F.lit("?")), F.lit(" · "), F.substring(F.coalesce("timestamp", F.lit("")), 1, 10), F.lit("] "))
    return hits.select("id", F.concat(head, F.col("snippet")).alias("line"))


def file_context(rows: DataFrame, path: str, session: str, vector: list[float], index: str | None = None) -> DataFrame:
    """What was said about a file, told by its name."""
    return search.context(rows, _last(path), vector, session, min_relevance=0.30, index=index)


def file_block(rows: DataFrame, path: str, cwd: str, vector: list[float], index: str | None = None) -> DataFrame:
    """path, block: what was said about a file, as it is put before a caller; three hits of the folder's project at most. Without a path or a hit there is no row.

    How often a path is answered is `streaming.requests`' affair.
    """
    if not path:
        return rows.select(F.lit("").alias("path"), F.lit("").alias("block")).where(F.lit(False))
    hits = search.hybrid(rows, _last(path) or path, vector, 5, min_relevance=0.30, index=index, project=_last(cwd) or None)
    hits = hits.orderBy(F.desc("score"), "id").limit(3)
    head = F.concat(F.lit("- ["), F.coalesce("project", F.lit("?")), F.lit(" · "), F.coalesce("source", F.lit("?")), F.lit(" · "), F.substring(F.coalesce("timestamp", F.lit("")), 1, 10), F.lit("] "))
    line = F.struct((-F.col("score")).alias("s"), "id", F.concat(head, T.snippet(F.coalesce("content", F.lit("")), 200)).alias("line"))
    one = hits.agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines")).where(F.size("lines") > 0)
    title = F.concat(F.lit("## Past discussion of `"), F.lit(path), F.lit("`"))
    return one.select(F.lit(path).alias("path"), F.array_join(F.concat(F.array(title), F.col("lines"), F.array(F.lit("_Search for what looks relevant to read it whole._"))), "\n").alias("block"))


def _last(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def todo_counts(resolved: DataFrame) -> DataFrame:
    """project, open_items, resolved_items."""
    return resolved.groupBy("project").agg(F.count_if(~F.col("resolved")).alias("open_items"), F.count_if("resolved").alias("resolved_items"))


def _day(time: str, none: str = "?") -> Column:
    return F.when(F.coalesce(time, F.lit("")) != "", F.substring(time, 1, 10)).otherwise(none)


def _known(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("?"))


def todo_lines(resolved: DataFrame, n: int = 50) -> DataFrame:
    """id, n, line: the newest to-dos; below one that is done, when and where that was said."""
    newest = resolved.orderBy(F.desc("timestamp"), "id", "n").limit(n)
    head = F.concat(F.lit("- ["), F.when(F.col("resolved"), "done").otherwise("open"), F.lit("] ["), _known("project"), F.lit(" · "), _known("source"), F.lit(" · "), _day("timestamp"), F.lit("] "), F.col("text"))
    done = F.when(F.col("resolved") & (F.coalesce("resolved_at", F.lit("")) != ""), F.concat(F.lit("\n    resolved "), F.substring("resolved_at", 1, 10), F.lit(" ("), _known("resolved_by"), F.lit(")"))).otherwise("")
    return newest.select("id", "n", F.concat(head, done).alias("line"))


def cluster_lines(clusters: DataFrame, told: bool = True) -> DataFrame:
    """cluster, line: how often, when and where each cluster was met. told: with its words."""
    first, last = _day("first_seen", ""), _day("last_seen", "")
    span = F.when((first != "") & (last != "") & (first != last), F.concat(first, F.lit(" → "), last)).when(last != "", last).when(first != "", first).otherwise("?")
    places = F.array_join(F.array_sort("projects"), ", ")
    head = F.concat(F.lit("- ["), F.col("session_count").cast("string"), F.lit(" sessions, "), span, F.lit(", "), F.when(places != "", places).otherwise("?"), F.lit("] "), F.col("example"))
    return clusters.select("cluster", (F.concat(head, F.lit("\n    fingerprint: "), F.col("fingerprint")) if told else head).alias("line"))


def decision_lines(found: DataFrame) -> DataFrame:
    """id, n, line: decisions as items of a Markdown list."""
    return found.select("id", "n", F.concat(F.lit("- **"), _known("project"), F.lit("** ("), _known("source"), F.lit(", "), _day("timestamp"), F.lit("): "), F.col("text")).alias("line"))


DECISION_QUERY = "decided chose going with will use agreed switching to plan is recommend"


def mined_decisions(rows: DataFrame, vector: list[float], mode: str = "semantic", project: str | None = None, query: str = DECISION_QUERY) -> DataFrame:
    """rank, id, n, text ...: decisions in the chunks that a search for them finds, 30 by meaning or 50 by both; of those that begin alike that of the best hit.

    Only what the search finds is looked at; `mining.decisions` looks at every chunk.
    """
    hits = search.search(rows, search.checked(query, project or "")[0], vector, mode, 30 if mode == "semantic" else 50, project=project)
    best = ["distance", "id"] if mode == "semantic" else [F.desc("score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("kw_rank")]
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(*best)))  # fifty rows at most
    found = mining.decision_sentences(ranked, also=("rank",))
    w = Window.partitionBy(F.substring(F.lower("text"), 1, 80)).orderBy("rank", "n")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def session_notes(exchanges: DataFrame, summaries: DataFrame) -> DataFrame:
    """path, note of each session of exchanges (n, role, content, timestamp, tools, and files and working_directory where they are known)."""
    known = set(exchanges.columns)
    files = F.array_distinct(F.flatten(F.collect_list("files"))) if "files" in known else F.array().cast("array<string>")
    folder = F.max("working_directory") if "working_directory" in known else F.lit("")
    first = {c: F.min_by(c, "n").alias(c) for c in ("source", "project", "git_branch", "started_at")}
    by = exchanges.groupBy("session_id").agg(*first.values(), F.max("timestamp").alias("ended_at"), F.array_sort(files).alias("files"), folder.alias("working_directory"))
    said = exchanges.select(F.col("n").cast("string").alias("id"), "session_id", "project", "source", F.struct("n", F.lit(0)).alias("timestamp"), "content")
    item = F.struct(F.col("timestamp.n").alias("at"), "n", "text")
    told = mining.decisions(said).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]).alias("decisions"))
    whole = by.join(summaries, "session_id", "left").join(told, "session_id", "left").join(lifecycle.transcript(exchanges), "session_id", "left")
    return notes(whole.withColumn("decisions", F.coalesce("decisions", F.array().cast("array<string>"))))


def notes(sessions: DataFrame) -> DataFrame:
    """path, note: a Markdown note for each session.

    sessions: session_id, source, project, git_branch, started_at, ended_at, summary, decisions, files (arrays), transcript, and
    working_directory where it is known, to which files are made relative. Up to ten decisions and twenty files are named, and how
    many files more there are.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    some = lambda c: F.when(text(c) != "", text(c))
    day = F.coalesce(F.substring(some("started_at"), 1, 10), F.lit("unknown"))
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("source: "), text("source")), F.concat(F.lit("project: "), text("project")), F.concat(F.lit("date: "), day), F.concat(F.lit("session_id: "), F.col("session_id")),
        F.concat(F.lit("branch: "), some("git_branch")), F.when(F.size("files") > 0, F.concat(F.lit("files_touched: "), F.size("files").cast("string"))), F.lit("---"),
    )
    branch = F.coalesce(F.concat(F.lit(" ("), some("git_branch"), F.lit(")")), F.lit(""))
    head = F.concat(F.lit("# "), text("source"), F.lit(" — "), text("project"), branch, F.lit("\n*"), text("started_at"), F.lit(" → "), text("ended_at"), F.lit("*"))
    folder = text("working_directory") if "working_directory" in sessions.columns else F.lit("")
    files = F.transform(F.slice("files", 1, 20), lambda f: F.concat(F.lit("- `"), T.relative_path(f, folder), F.lit("`")))
    more = F.when(F.size("files") > 20, F.concat(F.lit("\n- *...and "), (F.size("files") - 20).cast("string"), F.lit(" more*"))).otherwise("")
    decisions = F.transform(F.slice("decisions", 1, 10), lambda x: F.concat(F.lit("- "), x))
    part = lambda title, body, there: F.when(there, F.concat(F.lit(f"\n## {title}\n"), body, F.lit("\n")))
    note = F.concat_ws(
        "\n\n", front, head, part("Summary", F.col("summary"), text("summary") != ""), part("Key Decisions", F.array_join(decisions, "\n"), F.size("decisions") > 0),
        part("Files Touched", F.concat(F.array_join(files, "\n"), more), F.size("files") > 0), F.lit("## Transcript"), some("transcript"),
    )
    path = F.concat(T.sanitized(text("project")), F.lit("/"), day, F.lit("-"), T.sanitized(F.substring("session_id", 1, 8)), F.lit(".md"))
    return sessions.select("session_id", path.alias("path"), note.alias("note"))
