"""Problems, to-dos, rules and decisions out of chunks (id, session_id, project, source, content, timestamp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions import patterns as P
from lorekiln.functions import text as T
from lorekiln.operators import linking, tables

CHUNK = ("id", "session_id", "project", "source", "timestamp")
_ITEM = "struct<text:string,tokens:array<string>>"
MAX_LINE, MIN_LINE = 240, 8


def _any(patterns) -> str:
    return P.PYTHON + "|".join(f"(?:{p})" for p in patterns)


def _lines(chunks: DataFrame, literals) -> DataFrame:
    """n, text: the stripped lines that have a literal. Texts without one aren't split, lines without one aren't stripped."""
    rows = chunks.where(T.may_match(F.col("content"), literals)).select(*CHUNK, F.posexplode_outer(T.lines(F.col("content"))).alias("n", "raw"))
    return rows.where(T.may_match(F.col("raw"), literals)).withColumn("text", T.strip(F.col("raw"))).drop("raw")


def problem_signals(chunks: DataFrame) -> DataFrame:
    """n (line), text, tokens of every line that tells of a problem."""
    found = _lines(chunks, P.PROBLEM_LITERALS)
    found = found.where(F.length("text") >= MIN_LINE).withColumn("text", F.substring("text", 1, MAX_LINE)).where(F.col("text").rlike(_any(P.PROBLEMS)))
    return found.withColumn("tokens", T.words(F.col("text"), P.PROBLEM_STOPWORDS)).where(F.size("tokens") >= 3)


def fingerprints(signals: DataFrame) -> DataFrame:
    return signals.withColumn("fingerprint", F.array_join("tokens", " "))


def distinct_in_chunk(signals: DataFrame, threshold: float) -> DataFrame:
    """Per chunk, signals unlike all kept before them. A chunk's signals are gathered, no more."""
    by = signals.groupBy(*CHUNK).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text", "tokens"))), lambda x: F.struct(x["text"].alias("text"), x["tokens"].alias("tokens"))).alias("s"))
    return by.select(*CHUNK, F.posexplode(T.drop_similar(F.col("s"), _ITEM, threshold)).alias("n", "x")).select(*CHUNK, "n", "x.text", "x.tokens")


def _having(chunks: DataFrame, literals) -> DataFrame:
    """The rows with a literal, and _has: which."""
    content = F.col("content")
    return chunks.where(T.may_match(content, literals)).withColumn("_has", T.literals_in(content, literals))


_MATCH = "array<struct<m:string,b:string>>"


def _captures(content: Column, pattern: str, may: Column) -> Column:
    """Whole match and body of every match of a pattern with one or two groups.

    The text is searched once, and not at all without a literal of the pattern (may). A group is taken out of its match, which ends as it did in
    the text: with the text itself, or before something that no end of a text is like.
    """
    groups = 2 if pattern.count("(") - pattern.count("(?") == 2 else 1
    whole = F.regexp_extract_all(content, F.lit(P.PYTHON + pattern), F.lit(0))

    def row(m: Column, k: Column, n: Column) -> Column:
        last = (k == n - 1) & (F.endswith(content, m) | F.endswith(content, F.concat(m, F.lit("\n"))))
        seen = F.when(last, m).otherwise(F.concat(m, F.lit("\n\nx")))
        group = [F.regexp_extract(seen, P.PYTHON + pattern, g + 1) for g in range(groups)]
        body = group[0] if groups == 1 else F.concat_ws(" ", *[F.when(g != "", g) for g in group])
        return F.struct(m.alias("m"), T.strip(body).alias("b"))

    every = F.element_at(F.transform(F.array(whole), lambda found: F.transform(found, lambda m, k: row(m, k, F.size(found)))), 1)  # found once, not for each match
    return F.when(may, every).otherwise(F.array().cast(_MATCH))


def _cut(body: Column, most: int) -> Column:
    return F.when(F.length(body) > most, F.concat(F.regexp_replace(F.substring(body, 1, most), r"(?U)\s+$", ""), F.lit("…"))).otherwise(body)


def _extracted(chunks: DataFrame, patterns, literals, stopwords, most: int, similar: float, display) -> DataFrame:
    found = F.flatten(F.array(*[_captures(F.col("content"), p, T.has_any(F.col("_has"), x, literals)) for p, x in zip(patterns, literals, strict=True)]))
    item = lambda x: F.struct(display(x["m"], _cut(x["b"], most)).alias("text"), T.words(_cut(x["b"], most), stopwords).alias("tokens"))
    items = F.filter(F.transform(F.filter(found, lambda x: x["b"] != ""), item), lambda x: F.size(x["tokens"]) >= 2)
    rows = _having(chunks, literals).select(*CHUNK, items.alias("s"))
    # outer, so that no filter on the array's size is put below it, which would make the array twice
    return rows.select(*CHUNK, F.posexplode_outer(T.drop_similar(F.col("s"), _ITEM, similar)).alias("n", "x")).where("n IS NOT NULL").select(*CHUNK, "n", "x.text", "x.tokens")


def todos(chunks: DataFrame) -> DataFrame:
    shown = lambda m, b: T.strip(F.regexp_replace(b, r"(?U)^[\s,;:-]+", ""))
    return _extracted(chunks, P.TODOS, P.TODO_LITERALS, P.TODO_STOPWORDS, 200, 0.7, shown)


def rules(chunks: DataFrame) -> DataFrame:
    def shown(m: Column, b: Column) -> Column:
        at = F.instr(m, b)
        lead = F.when(at > 0, F.substring(m, F.lit(1), at - 1)).otherwise(m)
        trigger = F.regexp_replace(T.strip(lead), ":+$", "")
        return F.when(trigger != "", T.strip(F.concat(trigger, F.lit(" "), b))).otherwise(b)

    return _extracted(chunks, P.RULES, P.RULE_LITERALS, P.RULE_STOPWORDS, 180, 0.7, shown)


def done_signals(chunks: DataFrame) -> DataFrame:
    found = _lines(chunks, P.DONE_LITERALS)
    found = found.where((F.length("text") >= MIN_LINE) & F.col("text").rlike(P.PYTHON + P.DONE))
    return found.withColumn("tokens", T.words(F.col("text"), P.TODO_STOPWORDS)).where(F.size("tokens") > 0)


def resolved_todos(open_items: DataFrame, done: DataFrame, threshold: float = 0.4) -> DataFrame:
    """To-dos with resolved, resolved_by, resolved_at: the earliest later signal of the project that is similar.

    What is alike is told for a project's distinct word sets (`linking.across`), not for its rows. A to-do then asks each set like its own for the first signal after its time:
    of the same day, or the first of the next day that has one. So times are ordered within a set's day, and days within a set, however many rows say the same.
    """
    open_items, done = tables.kept(open_items, "todos"), tables.kept(done, "done")  # each is read several times below
    print_ = F.array_join(F.array_sort("tokens"), " ")
    asked = open_items.where("id IS NOT NULL AND project IS NOT NULL AND timestamp IS NOT NULL").select("project", print_.alias("k"), "tokens", "timestamp")
    told = done.where("id IS NOT NULL AND project IS NOT NULL AND timestamp IS NOT NULL").select("project", print_.alias("k"), "tokens", F.col("timestamp").alias("at"), F.col("id").alias("by"), F.col("n").alias("by_n"))
    sets = lambda rows: rows.groupBy("project", "k").agg(F.first("tokens").alias("tokens")).select("project", "tokens", F.struct("project", "k").alias("k"))
    alike = tables.kept(linking.across(sets(asked), sets(told), threshold, ("project",)).select("k.project", "k.k", F.col("k2.k").alias("k2")), "alike-sets")
    times = tables.kept(asked.select("project", "k", "timestamp").distinct(), "todo-times")
    key, day = ["project", "k2"], F.substring("at", 1, 10).alias("day")  # days are in the order of times

    signals = told.groupBy("project", F.col("k").alias("k2"), "at").agg(F.min(F.struct("at", "by", "by_n")).alias("x"))
    signals = tables.kept(signals.join(alike.select(*key).distinct().hint("merge"), key, "left_semi").select(*key, "at", day, "x"), "signals")
    wanted = tables.kept(times.join(alike.hint("merge"), ["project", "k"]).select(*key, F.col("timestamp").alias("at")).distinct().select(*key, "at", day, F.lit(None).cast(signals.schema["x"].dataType).alias("x")), "asked-times")

    # falling, and of equal times those that ask first: what was met before is what comes after
    def met(*by: str) -> Column:
        return F.last("x", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc("at"), F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))

    rows = wanted.withColumn("asks", F.lit(True)).unionByName(signals.withColumn("asks", F.lit(False)))
    within = rows.withColumn("found", met(*key, "day")).where("asks").select(*key, "at", "day", "found")
    days = wanted.select(*key, "day").distinct().withColumns({"x": F.lit(None).cast(signals.schema["x"].dataType), "asks": F.lit(True)}).unionByName(signals.groupBy(*key, "day").agg(F.min("x").alias("x")).withColumn("asks", F.lit(False)))
    days = days.withColumnRenamed("day", "at").withColumn("next", met(*key)).where("asks").select(*key, F.col("at").alias("day"), "next")
    answers = within.join(days.hint("merge"), [*key, "day"]).select(*key, F.col("at").alias("timestamp"), F.coalesce("found", "next").alias("x")).where("x IS NOT NULL")

    first = times.join(alike.hint("merge"), ["project", "k"]).join(answers.hint("merge"), [*key, "timestamp"]).groupBy("project", "k", "timestamp").agg(F.min("x").alias("x"))
    out = open_items.withColumn("k", print_).join(first.hint("merge"), ["project", "k", "timestamp"], "left").withColumn("x", F.when(F.col("id").isNotNull(), F.col("x")))
    return out.select(*open_items.columns, F.col("x").isNotNull().alias("resolved"), F.col("x.by").alias("resolved_by"), F.col("x.at").alias("resolved_at"))


def latest_todos(found: DataFrame, only_open: bool = True, n: int = 50) -> DataFrame:
    found = found.where("NOT resolved") if only_open else found
    return found.orderBy(F.desc("timestamp"), "id", "n").limit(n)


def decision_sentences(chunks: DataFrame, most: int = 300, also: tuple[str, ...] = ()) -> DataFrame:
    """n, text: every sentence that holds a decision, as often as one stands in it.

    A mark put in front of every match tells where matches start; a sentence runs from the ". " before
    that place to the ". " after it.
    """
    content = F.col("content")

    def sentences(p: str, literals: tuple[str, ...]) -> Column:
        parts = F.split(F.regexp_replace(content, P.PYTHON + p, "\u0001$0"), "\u0001")
        starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, 1, i), "")))
        return F.when(T.has_any(F.col("_has"), literals, P.DECISION_LITERALS) & (F.size(parts) > 1), F.transform(starts, _sentence)).otherwise(F.array().cast("array<string>"))

    def _sentence(at: Column) -> Column:
        lead, rest = F.substring(content, F.lit(1), at), F.substring(content, at + 1, F.length(content))
        begun = F.element_at(F.split(lead, r"\. "), -1)
        return T.strip(F.concat(begun, F.when(F.instr(rest, ". ") > 0, F.substring(rest, F.lit(1), F.instr(rest, ". "))).otherwise(rest)))

    rows = _having(chunks, P.DECISION_LITERALS)
    found = rows.select(*CHUNK, *also, F.posexplode_outer(F.flatten(F.array(*map(sentences, P.DECISIONS, P.DECISION_LITERALS)))).alias("n", "text")).where("text <> ''")
    return found.withColumn("text", F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text")))


def decisions(chunks: DataFrame, most: int = 300, key: int = 100) -> DataFrame:
    """n, text: sentences that hold a decision, the first of each session that begins alike."""
    found = decision_sentences(chunks, most)
    w = Window.partitionBy("session_id", F.substring(F.lower("text"), 1, key)).orderBy("timestamp", "id", "n")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def clusters(signals: DataFrame, threshold: float, min_sessions: int = 3, top: int = 20) -> DataFrame:
    """The largest clusters of signals: those whose word sets are linked by similarity, directly or through others.

    cluster (its smallest fingerprint), example (its earliest signal), fingerprint (all its words), session_count, projects, sources, first_seen, last_seen,
    signals. What grows with a cluster is counted, not gathered; `members` tells where each signal belongs.
    """
    told = members(signals, threshold)
    some = lambda name: F.when(F.col(name) != "", F.col(name))
    sessions = told.select("cluster", some("session_id").alias("s")).distinct().groupBy("cluster").agg(F.count("s").cast("int").alias("session_count"))
    top_rows = told.groupBy("cluster").agg(F.coalesce(F.max(some("timestamp")), F.lit("")).alias("last_seen"), F.coalesce(F.min(some("timestamp")), F.lit("")).alias("first_seen"), F.count(F.lit(1)).alias("signals"))
    top_rows = top_rows.join(sessions.where(F.col("session_count") >= min_sessions), "cluster").orderBy(F.desc("session_count"), F.desc("last_seen"), "cluster").limit(top)
    top_rows = tables.kept(top_rows, "clusters")
    of_top = told.join(F.broadcast(top_rows.select("cluster")), "cluster")  # top rows
    first = of_top.groupBy("cluster").agg(F.min(F.struct("timestamp", "id", "n", "text")).alias("x"), *(F.array_sort(F.collect_set(some(c))).alias(f"{c}s") for c in ("project", "source")))
    words = of_top.select("cluster", F.explode("tokens").alias("w")).distinct().groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("fingerprint"))
    out = top_rows.join(first, "cluster").join(words, "cluster")
    return out.select("cluster", F.col("x.text").alias("example"), "fingerprint", "session_count", "projects", "sources", "first_seen", "last_seen", "signals").orderBy(F.desc("session_count"), F.desc("last_seen"), "cluster")


def members(signals: DataFrame, threshold: float) -> DataFrame:
    """signals with the cluster of each, as a table; nulls are empty."""
    rows = tables.kept(fingerprints(signals.select(*CHUNK, "n", "text", "tokens").fillna("", list(CHUNK))), "signals")
    sets = tables.kept(rows.groupBy("fingerprint").agg(F.first("tokens").alias("tokens")), "fingerprints")
    roots = linking.clusters(sets, threshold).select(F.col("node").alias("fingerprint"), "root")
    return tables.kept(rows.join(roots.hint("merge"), "fingerprint", "left").withColumn("cluster", F.coalesce("root", "fingerprint")).drop("root"), "members")


CLUSTERED = "cluster int, example string, fingerprint string, session_count int, projects array<string>, sources array<string>, first_seen string, last_seen string, signals long"


def walked_clusters(signals: DataFrame, threshold: float, min_sessions: int = 3, top: int = 20) -> DataFrame:
    """Greedy clusters in the order of (timestamp, id, n), for the signals of a project or a few sessions.

    Each signal joins the most similar cluster so far, the earliest among equals, and widens it: the result rests on
    the order, so one task makes the walk, with an inverted index from words to clusters. `clusters` is what all signals of a corpus are given to.
    """
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        centres: list[set[str]] = []
        members: list[list] = []
        having: dict[str, set[int]] = {}
        for r in pdf.sort_values(["timestamp", "id", "n"], kind="stable").itertuples(index=False):
            words = set(r.tokens)
            best, score = None, 0.0
            for c in sorted(set().union(*(having.get(w, ()) for w in words))):
                both = len(words & centres[c])
                s = both / (len(words) + len(centres[c]) - both)
                if s >= threshold and s > score:
                    best, score = c, s
            if best is None:
                best = len(centres)
                centres.append(set())
                members.append([])
            centres[best] |= words
            members[best].append(r)
            for w in words:
                having.setdefault(w, set()).add(best)
        out = []
        for c, rows in enumerate(members):
            some = lambda name: sorted({getattr(x, name) for x in rows if getattr(x, name)})  # noqa: E731, B023
            sessions, times = some("session_id"), some("timestamp")
            out.append((c, rows[0].text, " ".join(sorted(centres[c])), len(sessions), some("project"), some("source"), min(times, default=""), max(times, default=""), len(rows)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in CLUSTERED.split(", ")])

    rows = signals.select(*CHUNK, "n", "text", "tokens").fillna("", list(CHUNK))
    found = rows.groupBy().applyInPandas(walk, CLUSTERED)
    return found.where(F.col("session_count") >= min_sessions).orderBy(F.desc("session_count"), F.desc("last_seen"), "cluster").limit(top)


def recurring_problems(chunks: DataFrame, min_sessions: int = 3, top: int = 20) -> DataFrame:
    return clusters(distinct_in_chunk(problem_signals(chunks), 0.5), 0.5, min_sessions, top)


def recurring_rules(chunks: DataFrame, min_sessions: int = 3, top: int = 20) -> DataFrame:
    return clusters(distinct_in_chunk(rules(chunks), 0.4), 0.4, min_sessions, top)


def least_sessions(value: object = 3) -> int:
    """How many sessions a caller wants a cluster to be met in: 2 to 20, and 3 for what is no number."""
    try:
        return max(2, min(int(value), 20))
    except (TypeError, ValueError):
        return 3
