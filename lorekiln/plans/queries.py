"""The queries and their SQL. Keys are what the driver runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.functions import patterns as P
from lorekiln.functions import text as T
from lorekiln.operators import index, ingest, lifecycle, mining, ranges, search, surfaces, tables, vectors
from lorekiln.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- SQL pieces ------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^[\s\x0B\x{{85}}\x{{A0}}]+|[\s\x0B\x{{85}}\x{{A0}}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _redact(x: str) -> str:
    for p in P.SECRETS:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '{P.REDACTED}', 'g')"
    return x


def _quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _words(x: str, stop) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9_]+'), lambda w: lower(w)), lambda w: len(w) >= 3 AND NOT list_contains({V.quoted(stop)}, w))))"


def _jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


def _fold(signals: str, threshold: float) -> str:
    """CTEs after `signals` (id, n, tokens ...): kept has the rows that are unlike all kept before them in their chunk."""
    return f"""seq AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM {signals}),
fold AS (
  SELECT id, k, [tokens] AS seen, true AS good FROM seq WHERE k = 1
  UNION ALL
  SELECT id, k, CASE WHEN hit THEN seen ELSE list_append(seen, tokens) END, NOT hit FROM (
    SELECT s.id, s.k, f.seen, s.tokens, len(list_filter(f.seen, lambda p: {_jaccard("p", "s.tokens")} >= {threshold})) > 0 AS hit FROM fold f JOIN seq s ON s.id = f.id AND s.k = f.k + 1)
), kept AS (SELECT seq.*, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS pos FROM seq JOIN fold USING (id, k) WHERE good)"""


_EXCHANGE_TEXT = f"""'**' || CASE role WHEN 'human' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE upper(role[1]) || lower(role[2:]) END || '**: ' || {_redact("content")}
  || CASE WHEN len(tools) > 0 THEN chr(10) || '[Tools used: ' || array_to_string(tools, ', ') || ']' ELSE '' END"""
_TEXTS = f"{V.EXCHANGES_SQL}, texts AS (SELECT *, {_EXCHANGE_TEXT} AS text FROM exchanges WHERE role <> 'system'), sized AS (SELECT *, (length(text) // 4)::INTEGER AS tokens FROM texts)"
_CHUNKED = f"""{_TEXTS}, turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n) AS k FROM sized),
walk AS (
  SELECT session_id, k, tokens AS size, 0 AS c FROM turns WHERE k = 1
  UNION ALL
  SELECT t.session_id, t.k, CASE WHEN w.size + t.tokens > 800 THEN t.tokens ELSE w.size + t.tokens END, w.c + (w.size + t.tokens > 800)::INTEGER FROM walk w JOIN turns t ON t.session_id = w.session_id AND t.k = w.k + 1
), parts AS (
  SELECT session_id, any_value(source) AS source, any_value(project) AS project, any_value(git_branch) AS git_branch, any_value(started_at) AS started_at, c AS chunk_index,
         string_agg(text, chr(10) || chr(10) ORDER BY k) AS body, min_by(timestamp, k) AS first_ts FROM walk JOIN turns USING (session_id, k) GROUP BY session_id, c
), made AS (
  SELECT substr(sha256(session_id || ':' || chunk_index), 1, 16) AS id, session_id, source, project, git_branch,
         CASE WHEN chunk_index = 0 THEN '[' || source || '] Project: ' || project || CASE WHEN git_branch <> '' THEN ' | Branch: ' || git_branch ELSE '' END || ' | ' || started_at || chr(10) || chr(10) ELSE '' END || body AS content,
         coalesce(lead(first_ts) OVER (PARTITION BY session_id ORDER BY chunk_index), started_at) AS timestamp, chunk_index FROM parts)"""
_KEYWORDS = f"list_filter(regexp_extract_all(lower({{}}), '[a-zA-Z][a-zA-Z0-9_-]{{{{2,}}}}'), lambda w: NOT list_contains({V.quoted(P.SUMMARY_STOPWORDS)}, w))"


def _top_words(groups: str, key: str, text: str, n: int) -> str:
    """CTEs: top has key, keywords for each row of groups (key, text)."""
    return f"""found AS (SELECT {key}, unnest(list_zip(w, range(len(w)))) AS x FROM (SELECT {key}, {_KEYWORDS.format(text)} AS w FROM {groups})),
counted AS (SELECT {key}, x[1] AS w, count(*) AS c, min(x[2]) AS p FROM found GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY c DESC, p) AS r FROM counted),
top AS (SELECT {key}, list(w ORDER BY r) AS keywords FROM ranked WHERE r <= {n} GROUP BY {key})"""


_TERMS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def _bm25(rows: str, phrase_list: list[list[str]], where: str = "true") -> str:
    """CTEs: hits has the columns of rows and bm25."""
    f = []
    for p in phrase_list:
        same = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p))
        f.append(f"len(list_filter(range(1, len(t) - {len(p)} + 2), lambda i: {same}))")
    cols = ", ".join(f"{x} AS f{k}" for k, x in enumerate(f))
    ns = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(f)))
    score = " + ".join(f"(CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(f)))
    every = " AND ".join(f"f{k} > 0" for k in range(len(f)))
    return f"""termed AS (SELECT *, {_TERMS.format("content")} AS t FROM {rows}), measured AS (SELECT *, len(t) AS dl, {cols} FROM termed),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {ns} FROM measured),
hits AS (SELECT measured.* EXCLUDE (t), -({score}) AS bm25 FROM measured, corpus WHERE {every} AND {where})"""


_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
QUERY = "the and"


#: A vector that some row of the project has.
_VECTOR_DE = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'de'))"


def _vectored_sql(rows: str = "chunks", vector: str = _VECTOR) -> str:
    return f"{V.CHUNKS_SQL if rows == 'chunks' else V.CUED_SQL}, vectored AS (SELECT r.*, 1 - list_cosine_similarity(embedding::DOUBLE[], {vector}) AS distance FROM {rows} r JOIN embeddings ON vec_id::VARCHAR = id)"


def _hybrid(k: int, least: float = 0.0, where: str = "true", query: str = QUERY, rows: str = "chunks", vector: str = _VECTOR) -> str:
    fetch = max(3 * k, 10)
    return f"""{_vectored_sql(rows, vector)}, {_bm25("vectored", [[w] for w in query.split()], where)},
near AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS sr FROM (SELECT id, distance FROM vectored WHERE {where} ORDER BY distance, id LIMIT {fetch}) WHERE {f"1 - distance >= {least}" if least else "true"}),
nears AS (SELECT *, CASE WHEN max(1 - distance) OVER () <= min(1 - distance) OVER () THEN 1 ELSE (1 - distance - min(1 - distance) OVER ()) / (max(1 - distance) OVER () - min(1 - distance) OVER ()) END AS s FROM near),
said AS (SELECT id, bm25, row_number() OVER (ORDER BY bm25, id) AS kr FROM (SELECT id, bm25 FROM hits ORDER BY bm25, id LIMIT {fetch})),
saids AS (SELECT *, CASE WHEN max(-bm25) OVER () <= min(-bm25) OVER () THEN 1 ELSE (-bm25 - min(-bm25) OVER ()) / (max(-bm25) OVER () - min(-bm25) OVER ()) END AS w FROM said),
fused AS (SELECT id, nears.distance, coalesce(s, 0) AS s, coalesce(w, 0) AS w, 0.5 * coalesce(s, 0) + 0.5 * coalesce(w, 0) AS score, sr, kr FROM nears FULL JOIN saids USING (id)
  ORDER BY score DESC, sr NULLS LAST, kr NULLS LAST LIMIT {k})"""


def _vectored(spark: SparkSession, d: str, rows: Callable[[SparkSession, str], DataFrame] = V.chunks) -> DataFrame:
    vectors = V.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return rows(spark, d).join(vectors, "id")


def _vector(spark: SparkSession, d: str) -> list[float]:
    return V.table(spark, d, "embeddings").where("vec_id = 0").first().embedding  # one row


# --- ingest ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_redact('text')}) AS redacted FROM documents")
def redact_documents(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted"))


@query(f"SELECT source, count(*) AS n, count(*) FILTER ({_redact('text')} <> text) AS changed FROM documents GROUP BY source")
def redaction_counts_by_source(spark, d):
    return V.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(T.redact(F.col("text")) != F.col("text")).alias("changed"))


@query(
    f"SELECT page_id, {' OR '.join(f'regexp_matches(lower(url), {_quote(p)})' for p in P.SENSITIVE_PATHS)} OR url LIKE '%/1%' AS sensitive FROM pages"
)
def sensitive_paths(spark, d):
    return V.table(spark, d, "pages").select("page_id", (T.is_sensitive_path(F.col("url")) | F.col("url").contains("/1")).alias("sensitive"))


@query(f"WITH {_TEXTS} SELECT session_id, n, md5(text) AS text, tokens FROM sized")
def exchange_text(spark, d):
    return ingest.exchange_rows(V.exchanges(spark, d)).select("session_id", "n", F.md5("text").alias("text"), "tokens")


@query(f"WITH RECURSIVE {_CHUNKED} SELECT id, session_id, chunk_index, md5(content) AS content FROM made")
def chunk_conversations(spark, d):
    return ingest.chunks(V.exchanges(spark, d)).select("id", "session_id", "chunk_index", F.md5("content").alias("content"))


@query(f"WITH RECURSIVE {_CHUNKED} SELECT id, session_id, chunk_index, timestamp, md5(content) AS content FROM made")
def chunk_by_ranges(spark, d):
    return ranges.chunks(V.exchanges(spark, d)).select("id", "session_id", "chunk_index", "timestamp", F.md5("content").alias("content"))


@query(f"WITH RECURSIVE {_CHUNKED} SELECT id, timestamp FROM made")
def chunk_timestamps(spark, d):
    return ingest.chunks(V.exchanges(spark, d)).select("id", "timestamp")


@query(
    f"""WITH {V.EXCHANGES_SQL}, humans AS (SELECT session_id, string_agg(content, ' ' ORDER BY n) AS text FROM exchanges WHERE role = 'human' GROUP BY session_id), {_top_words("humans", "session_id", "text", 5)},
per AS (SELECT session_id, count(*) FILTER (role IN ('human', 'assistant')) AS n, list_sort(list_distinct(flatten(list(tools)))) AS tools FROM exchanges GROUP BY session_id)
SELECT session_id, concat_ws('. ', n || ' exchanges', CASE WHEN len(keywords) > 0 THEN 'about ' || array_to_string(keywords[1:4], ', ') END, CASE WHEN len(tools) > 0 THEN 'Tools: ' || array_to_string(tools[1:5], ', ') END) || '.' AS summary
FROM per LEFT JOIN top USING (session_id)"""
)
def session_summary(spark, d):
    return ingest.summaries(V.exchanges(spark, d))


@query(f"WITH {V.CHUNKS_SQL}, {_top_words('chunks', 'id', 'content', 5)} SELECT id, array_to_string(keywords, ',') AS keywords FROM top")
def keyword_top_n(spark, d):
    rows = V.chunks(spark, d).withColumn("n_order", F.lit(0))
    return ingest.keywords(rows, ["id"], "content", 5).select("id", F.array_join("keywords", ",").alias("keywords"))


@query(f"WITH {V.CHUNKS_SQL}, s AS (SELECT session_id, count(*) FILTER (id::BIGINT % 4 = 0) AS added FROM chunks GROUP BY session_id) SELECT count(*) FILTER (added > 0) AS sessions_ingested, sum(added)::BIGINT AS chunks_added, count(*) FILTER (added = 0) AS sessions_skipped FROM s")
def ingest_anti_join(spark, d):
    rows = V.chunks(spark, d)
    return ingest.ingest_stats(rows, rows.where(F.col("id").cast("long") % 4 != 0))


@query(f"WITH {V.CHUNKS_SQL} SELECT id FROM chunks WHERE id::BIGINT % 3 = 0")
def index_backfill_missing(spark, d):
    rows = V.chunks(spark, d)
    lengths, _ = search.build_index(rows.where(F.col("id").cast("long") % 3 != 0))
    return search.missing_from_index(rows, lengths).select("id")


@query(f"WITH {V.CHUNKS_SQL}, p AS (SELECT id, unnest({_TERMS.format('content')}) AS term FROM chunks) SELECT term, count(DISTINCT id) AS docs, count(*) AS places FROM p GROUP BY term")
def index_postings(spark, d):
    _, postings = search.build_index(V.chunks(spark, d))
    return postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("places"))


# --- storage ---------------------------------------------------------------------------------------


def _changed(spark: SparkSession, d: str) -> tuple[str, list[tuple[str, int]]]:
    """An index of its own: two in three rows, then all of them appended, a language, a source of another and a session deleted, segments merged; and what each step counted."""
    path, rows = tables.folder(spark, "changed"), V.chunks(spark, d)
    steps = [("written", index.write(rows.where("id % 3 <> 0"), path)), ("appended", index.append(rows, path)), ("again", index.append(rows, path))]
    steps += [("project", index.delete(spark, path, project="fr")), ("source", index.delete(spark, path, project="de", source="src3")), ("session", index.delete(spark, path, session_id="s3"))]
    steps += [("merged", index.merge(spark, path, everything=True)), ("left", index.figures(spark, path)[0])]
    return path, steps


_LEFT = "left_over AS (SELECT * FROM chunks WHERE project <> 'fr' AND NOT (project = 'de' AND source = 'src3') AND session_id <> 's3')"


@query(
    f"""WITH {V.CHUNKS_SQL}, {_LEFT}, c AS (SELECT count(*) AS n, count(*) FILTER (id::BIGINT % 3 <> 0) AS w, count(*) FILTER (project = 'fr') AS p, count(*) FILTER (project = 'de' AND source = 'src3') AS s,
      count(*) FILTER (session_id = 's3' AND project <> 'fr' AND NOT (project = 'de' AND source = 'src3')) AS e FROM chunks)
    SELECT unnest(['written', 'appended', 'again', 'project', 'source', 'session', 'merged', 'left']) AS step, unnest([w, n - w, 0, p, s, e, 2, (SELECT count(*) FROM left_over)]) AS n FROM c"""
)
def index_change_counts(spark, d):
    return spark.createDataFrame(_changed(spark, d)[1], "step string, n long")


@query(f"WITH {V.CHUNKS_SQL}, {_LEFT}, {_bm25('left_over', [['the'], ['and']])} SELECT id, round(bm25, 8) AS bm25 FROM hits ORDER BY hits.bm25, id LIMIT 20")
def keyword_after_changes(spark, d):
    return index.keyword(spark, _changed(spark, d)[0], QUERY, 20).select("id", F.round("bm25", 8).alias("bm25"))


@query(f"WITH {V.CHUNKS_SQL}, {_bm25('chunks', [['the']])} SELECT id, round(bm25, 8) AS bm25 FROM hits ORDER BY hits.bm25, id LIMIT 10")
def keyword_one_word(spark, d):
    return index.keyword(spark, V.index(spark, d), "the", 10).select("id", F.round("bm25", 8).alias("bm25"))


@query(f"WITH {V.CHUNKS_SQL} SELECT project, count(*) AS n FROM chunks WHERE project <> 'fr' GROUP BY project")
def delete_by_project(spark, d):
    return lifecycle.deleted(V.chunks(spark, d), project="fr").groupBy("project").agg(F.count("*").alias("n"))


@query(f"WITH {V.CHUNKS_SQL} SELECT id, session_id FROM chunks WHERE session_id <> 's3'")
def delete_by_session(spark, d):
    return lifecycle.deleted(V.chunks(spark, d), project="fr", session="s3").select("id", "session_id")


@query(f"WITH {V.CHUNKS_SQL} SELECT id, content, timestamp FROM chunks WHERE project = 'de'")
def export_project(spark, d):
    kind = "id string, content string, timestamp string"
    return lifecycle.exported(V.chunks(spark, d), "de").select(F.from_json("json", kind).alias("j")).select("j.*")


@query(f"WITH {V.CHUNKS_SQL} SELECT id, '## ' || project || ' — ' || substr(timestamp, 1, 10) || chr(10) || chr(10) || content || chr(10) AS block FROM chunks")
def export_markdown(spark, d):
    return lifecycle.export_markdown(V.chunks(spark, d))


@query(
    f"""WITH {V.EXCHANGES_SQL}, s AS (SELECT session_id, any_value(project) AS project, any_value(git_branch) AS git_branch, any_value(started_at) AS started_at, count(*) FILTER (role = 'human') AS n FROM exchanges GROUP BY session_id)
SELECT substr(started_at, 1, 10) AS date, '# ' || substr(started_at, 1, 10) || chr(10) || chr(10) || string_agg('- [[' || session_id || ']] ' || project || ': ' || n || ' exchanges' || CASE WHEN git_branch <> '' THEN ' on ' || git_branch ELSE '' END || '. ' || 'x', chr(10) ORDER BY session_id) AS digest
FROM s GROUP BY substr(started_at, 1, 10)"""
)
def daily_digest(spark, d):
    by = V.exchanges(spark, d).groupBy("session_id").agg(F.first("project").alias("project"), F.first("git_branch").alias("git_branch"), F.first("started_at").alias("started_at"), F.count_if(F.col("role") == "human").alias("exchanges"))
    return lifecycle.daily_digest(by.withColumn("summary", F.lit("x")))


@query(r"SELECT page_id, trim(regexp_replace(url, '[^\pL\pN\p{Mn}_\-.]', '_', 'g'), '.') AS name FROM pages")
def path_sanitize(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.sanitized(F.col("url")).alias("name"))


def _utf8(x: str, most: int) -> str:
    """x within most bytes: continuation bytes at the cut go, and so does the lead byte before them."""
    h = f"hex(encode({x}))"
    back = f"length(regexp_extract(substr({h}, {2 * most - 7}, 8), '((?:[89AB][0-9A-F])*)$', 1))"
    lead = f"(substr({h}, {2 * most} - {back} - 1, 1) IN ('C', 'D', 'E', 'F'))::INTEGER * 2"
    size = f"octet_length(encode({x}))"
    return f"CASE WHEN {size} <= {most} THEN {x} ELSE decode(unhex(substr({h}, 1, {2 * most} - {back} - {lead}))) || chr(10) || chr(10) || '*[truncated — ' || ({size} - {most} + {back} // 2) || ' bytes omitted; full content in the store]*' END"


#: CTE written: session_id, transcript. No session of the tables has so many exchanges that some are left out; a test has.
_WRITTEN = f"""redacted AS (SELECT *, {_redact("content")} AS r FROM exchanges),
blocks AS (SELECT session_id, n, CASE role WHEN 'human' THEN '### You' WHEN 'assistant' THEN '### Assistant' || CASE WHEN len(tools) > 0 THEN chr(10) || '> Tools: ' || array_to_string(tools, ', ') ELSE '' END END || chr(10) || {_utf8("r", 2000)} AS p FROM redacted),
written AS (SELECT session_id, coalesce(string_agg(p, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n), '') AS transcript FROM blocks GROUP BY session_id)"""


@query(f"WITH {V.EXCHANGES_SQL}, {_WRITTEN} SELECT session_id, md5(transcript) AS transcript FROM written")
def session_transcripts(spark, d):
    return lifecycle.transcript(V.exchanges(spark, d)).select("session_id", F.md5("transcript").alias("transcript"))


# --- filters and functions -------------------------------------------------------------------------


@query(f"WITH {V.CHUNKS_SQL} SELECT id FROM chunks WHERE project = 'en' AND source = 'src3' AND git_branch = 'main'")
def filter_chunks(spark, d):
    return search.filtered(V.chunks(spark, d), project="en", source="src3", git_branch="main").select("id")


@query(f"WITH {V.CHUNKS_SQL} SELECT id, timestamp FROM chunks WHERE project = 'en' ORDER BY timestamp DESC, id LIMIT 10")
def recent_project_chunks(spark, d):
    return lifecycle.recent(V.chunks(spark, d).where("project = 'en'"), 10, F.desc("timestamp"), F.col("id")).select("id", "timestamp")


@query(f"WITH {V.CHUNKS_SQL} SELECT id, chunk_index FROM chunks WHERE session_id = 's7' ORDER BY chunk_index")
def session_chunks(spark, d):
    return V.chunks(spark, d).where("session_id = 's7'").orderBy("chunk_index").select("id", "chunk_index")


@query(f"WITH {V.CHUNKS_SQL} SELECT id, concat_ws(' | ', project, source, nullif(git_branch, ''), substr(timestamp, 1, 10)) AS line FROM chunks")
def compact_metadata(spark, d):
    return V.chunks(spark, d).select("id", T.compact_metadata(F.col("project"), F.col("source"), F.col("git_branch"), F.col("timestamp")).alias("line"))


_NOISY = "CASE id::BIGINT % 3 WHEN 0 THEN '[Tools used: Read]' || chr(10) WHEN 1 THEN '**Assistant**: [Used tools: Bash]' || chr(10) ELSE '' END || content"


def _noisy(spark, d):
    n = F.col("id").cast("long") % 3
    return V.chunks(spark, d).withColumn("content", F.concat(F.when(n == 0, "[Tools used: Read]\n").when(n == 1, "**Assistant**: [Used tools: Bash]\n").otherwise(""), F.col("content")))


@query(f"WITH {V.CHUNKS_SQL} SELECT id, md5(content) AS text FROM chunks")
def strip_tool_noise(spark, d):
    return _noisy(spark, d).select("id", F.md5(T.strip_tool_noise(F.col("content"))).alias("text"))


def _fenced(spark, d):
    code = F.concat(F.lit("```py\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("chunk_index") + 2), lambda k: F.concat(F.lit("line "), k.cast("string"))), "\n"), F.lit("\n```\n"))
    return V.chunks(spark, d).withColumn("content", F.concat(code, F.col("content")))


_FENCED = """'```py' || chr(10) || array_to_string(list_transform(range(1, least(chunk_index + 3, 5)), lambda k: 'line ' || k), chr(10)) || chr(10) || CASE WHEN chunk_index + 2 > 4 THEN '  ... (truncated)' || chr(10) ELSE '' END || '```' || chr(10) || content"""


@query(f"WITH {V.CHUNKS_SQL} SELECT id, {_FENCED} AS text FROM chunks")
def truncate_code(spark, d):
    return _fenced(spark, d).select("id", T.truncate_code(F.col("content")).alias("text"))


@query(f"WITH {V.CHUNKS_SQL} SELECT id, {_strip(f'regexp_replace({_FENCED}, chr(10) || chr(10) || chr(10) || chr(43), chr(10) || chr(10), chr(103))')} AS text FROM chunks")
def optimize_content(spark, d):
    rows = _fenced(spark, d).withColumn("content", F.concat(F.lit("[Used tools: Read]\n"), F.col("content"), F.lit("\n \n")))
    return rows.select("id", T.optimized(F.col("content")).alias("text"))


@query(f"WITH {V.CHUNKS_SQL}, f AS (SELECT id, {_strip('replace(content, chr(10), chr(32))')} AS t FROM chunks) SELECT id, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '...' ELSE t END AS text FROM f")
def snippet(spark, d):
    return V.chunks(spark, d).select("id", T.snippet(F.col("content"), 180, "...").alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(make_timestamp((1700000000000 + event_id * 1000) * 1000), '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM events")
def epoch_to_iso(spark, d):
    ms = F.when(F.col("event_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.lit(1_700_000_000_000) + F.col("event_id") * 1000)
    return V.table(spark, d, "events").select("event_id", T.epoch_ms_iso(ms).alias("iso"))


@query(f"WITH {V.CHUNKS_SQL} SELECT id, substr(sha256(id), 1, 16) AS sha256, substr(sha1(content), 1, 16) AS sha1 FROM chunks")
def hashes(spark, d):
    return V.chunks(spark, d).select("id", F.substring(F.sha2("id", 256), 1, 16).alias("sha256"), F.substring(F.sha1(F.col("content")), 1, 16).alias("sha1"))


@query("SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS name FROM pages")
def basenames(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.basename(F.col("url")).alias("name"))


# --- search ----------------------------------------------------------------------------------------


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}) DESC, vec_id::VARCHAR LIMIT 10")
def semantic_topk(spark, d):
    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "embedding")
    return search.semantic(rows, _vector(spark, d), 10).select("vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}) DESC, vec_id::VARCHAR LIMIT 10")
def semantic_indexed(spark, d):
    rows = vectors.nearest(spark, V.vector_index(spark, d), _vector(spark, d), 10, exact=True)
    return rows.select(F.col("id").cast("long").alias("vec_id"), F.round(1 - F.col("distance"), 6).alias("similarity"))


@query()
def semantic_ann(spark, d):
    """The vectors of every hundredth row against all rows. No SQL: neighbours are approximate; a test holds their recall against all distances."""
    asked = V.table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    found = vectors.nearest_many(spark, V.vector_index(spark, d), asked, 10)
    return found.select(F.col("query").cast("long").alias("query_id"), "rank", F.col("id").cast("long").alias("vec_id"), F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(f"WITH {V.CHUNKS_SQL}, {_bm25('chunks', [['the'], ['and']])} SELECT id, round(bm25, 8) AS bm25 FROM hits ORDER BY hits.bm25, id LIMIT 20")
def keyword_bm25(spark, d):
    return index.keyword(spark, V.index(spark, d), QUERY, 20).select("id", F.round("bm25", 8).alias("bm25"))


@query(f"WITH {V.CHUNKS_SQL}, {_bm25('chunks', [['of', 'the'], ['and']], where=chr(39) + 'en' + chr(39) + ' = project')} SELECT id, round(bm25, 8) AS bm25 FROM hits ORDER BY hits.bm25, id LIMIT 20")
def keyword_phrase(spark, d):
    return index.keyword(spark, V.index(spark, d), "of-the ... AND", 20, project="en").select("id", F.round("bm25", 8).alias("bm25"))


@query(f"WITH {_hybrid(5)} SELECT id, round(distance, 6) AS distance, round(s, 6) AS sem_score, round(w, 6) AS kw_score, round(score, 6) AS score FROM fused")
def hybrid_fusion(spark, d):
    hits = search.hybrid(_vectored(spark, d), QUERY, _vector(spark, d), 5, index=V.index(spark, d, vectored=True))
    return hits.select("id", *[F.round(c, 6).alias(c) for c in ("distance", "sem_score", "kw_score", "score")])


@query("SELECT event_id, CASE WHEN max(value) OVER w <= min(value) OVER w THEN 1 ELSE round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 9) END AS v FROM events WINDOW w AS (PARTITION BY user_id)")
def minmax_normalize(spark, d):
    return V.table(spark, d, "events").select("event_id", F.round(search.normalized(F.col("value"), Window.partitionBy("user_id")), 9).alias("v"))


_AGE = f"greatest((epoch_us(TIMESTAMP '{V.NOW}') - epoch_us(replace(timestamp, 'Z', '')::TIMESTAMP)) / 86400000000, 0)"


@query(f"WITH {_hybrid(5)} SELECT id, round(score * exp(-{_AGE} / 30.0), 12) AS decayed FROM fused JOIN chunks USING (id)")
def time_decay(spark, d):
    hits = search.search(_vectored(spark, d), QUERY, _vector(spark, d), now=V.NOW, index=V.index(spark, d, vectored=True))
    return hits.select("id", F.round("decayed", 12).alias("decayed"))


_KEY = "substr(regexp_replace(" + _strip("lower(content)") + r", '[\s\x0B]+', ' ', 'g'), 1, 100)"


@query(f"WITH {V.CHUNKS_SQL} SELECT arg_min(id, id::BIGINT) AS id, {_KEY} AS key FROM chunks GROUP BY {_KEY}")
def result_dedup(spark, d):
    return search.deduped(V.chunks(spark, d), [F.col("id").cast("long")]).select("id", T.dedup_key(F.col("content")).alias("key"))


@query(f"WITH {V.CHUNKS_SQL} SELECT id, coalesce(substr(list_filter(list_transform(string_split(content, chr(10)), lambda x: {_strip('x')}), lambda x: NOT starts_with(x, '[') AND length(x) > 10)[1], 1, 120), '') AS preview FROM chunks")
def search_lite_preview(spark, d):
    return V.chunks(spark, d).select("id", T.preview(F.col("content")).alias("preview"))


@query(f"WITH {_hybrid(10, 0.25)}, kept AS (SELECT *, score * exp(-{_AGE} / 30.0) AS decayed, {_KEY} AS key FROM fused JOIN chunks USING (id)) SELECT arg_min(id, (-decayed, id)) AS id, round(max(decayed), 12) AS decayed FROM kept GROUP BY key")
def search_lite(spark, d):
    return search.lite(_vectored(spark, d), QUERY, _vector(spark, d), V.NOW, index=V.index(spark, d, vectored=True)).select("id", F.round("decayed", 12).alias("decayed"))


@query(f"WITH {_hybrid(5, 0.35)} SELECT id FROM fused JOIN chunks USING (id) WHERE session_id <> 's0' ORDER BY score DESC, id LIMIT 3")
def exclude_session(spark, d):
    return search.context(_vectored(spark, d), QUERY, _vector(spark, d), "s0", index=V.index(spark, d, vectored=True)).select("id")


# --- what callers are shown ------------------------------------------------------------------------

_META = "concat_ws(' | ', project, source, nullif(git_branch, ''), substr(timestamp, 1, 10))"
_OPTIMAL = _strip("regexp_replace(content, chr(10) || chr(10) || chr(10) || chr(43), chr(10) || chr(10), chr(103))")


def _shown(k: int, rank: str = "score", where: str = "true") -> str:
    return f"""WITH {_hybrid(k, 0.25, where)}, found AS (SELECT chunks.*, fused.distance, {rank} AS v, {_OPTIMAL} AS t FROM fused JOIN chunks USING (id)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY v DESC, id) AS r FROM found) WHERE r = 1)
SELECT id, row_number() OVER (ORDER BY v DESC, id) AS place, round((1 - distance) * 100)::INTEGER AS relevance, {_META} AS meta, md5(CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || '...' ELSE t END) AS text FROM one"""


def _told(found: DataFrame) -> DataFrame:
    return found.withColumn("text", F.md5("text"))


@query(_shown(5))
def search_full(spark, d):
    return _told(surfaces.full(_vectored(spark, d), QUERY, _vector(spark, d), index=V.index(spark, d, vectored=True)))


@query(_shown(8, f"score * exp(-{_AGE} / 30.0)", "project = 'de'"))
def project_context(spark, d):
    return _told(surfaces.project_context(_vectored(spark, d), "de", _vector(spark, d), V.NOW, topic=QUERY, index=V.index(spark, d, vectored=True)))


@query(_shown(10))
def cross_reference(spark, d):
    return _told(surfaces.cross_reference(_vectored(spark, d), QUERY, _vector(spark, d), index=V.index(spark, d, vectored=True)))


@query(f"WITH {_hybrid(5)} SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place, array_to_string(string_split(substr(content, 1, 400), chr(10))[1:8], chr(10)) AS text FROM fused JOIN chunks USING (id)")
def search_terminal(spark, d):
    return surfaces.terminal(_vectored(spark, d), QUERY, _vector(spark, d), index=V.index(spark, d, vectored=True))


_SNIP = _strip("replace(content, chr(10), chr(32))")


@query(f"WITH {_hybrid(5, 0.35, chr(39) + 'en' + chr(39) + ' = project')}, s AS (SELECT *, {_SNIP} AS t FROM fused JOIN chunks USING (id) WHERE session_id <> 's0') SELECT id, '- [' || project || ' · ' || source || ' · ' || substr(timestamp, 1, 10) || '] ' || CASE WHEN length(t) > 220 THEN substr(t, 1, 220) || '…' ELSE t END AS line FROM s ORDER BY score DESC, id LIMIT 3")
def prompt_context(spark, d):
    return surfaces.prompt_context(_vectored(spark, d), "  the    and ", "/home/me/en/", "s0", _vector(spark, d), V.index(spark, d, vectored=True))


@query(f"WITH {_hybrid(5, 0.3)}, s AS (SELECT *, {_SNIP} AS t FROM fused JOIN chunks USING (id) WHERE session_id <> 's1') SELECT id, project, source, timestamp, CASE WHEN length(t) > 220 THEN substr(t, 1, 220) || '…' ELSE t END AS snippet FROM s ORDER BY score DESC, id LIMIT 3")
def file_context(spark, d):
    return surfaces.file_context(_vectored(spark, d), "/src/the and", "s1", _vector(spark, d), V.index(spark, d, vectored=True))


@query(f"""WITH {_hybrid(5, 0.3, chr(39) + 'en' + chr(39) + ' = project')}, s AS (SELECT *, {_SNIP} AS t FROM fused JOIN chunks USING (id) ORDER BY score DESC, id LIMIT 3)
SELECT '/src/the and' AS path, '## Past discussion of `/src/the and`' || chr(10) || string_agg('- [' || project || ' · ' || source || ' · ' || substr(timestamp, 1, 10) || '] ' || CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END, chr(10) ORDER BY score DESC, id)
  || chr(10) || '_Search for what looks relevant to read it whole._' AS block FROM s HAVING count(*) > 0""")
def file_block(spark, d):
    return surfaces.file_block(_vectored(spark, d), "/src/the and", "/home/me/en", _vector(spark, d), V.index(spark, d, vectored=True))


_AT_START = "recent work on de"


@query(f"WITH {_hybrid(3, 0.3, chr(39) + 'de' + chr(39) + ' = project', _AT_START, vector=_VECTOR_DE)}, s AS (SELECT *, score * exp(-{_AGE} / 30.0) AS v, {_SNIP} AS t FROM fused JOIN chunks USING (id)) SELECT substr(timestamp, 1, 10) AS day, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '...' ELSE t END AS snippet FROM s")
def session_start(spark, d):
    rows = _vectored(spark, d)
    vector = rows.where("project = 'de'").orderBy(F.col("id").cast("long")).select("embedding").first()  # one row
    return surfaces.session_start(rows, "/home/me/de/", list(vector.embedding) if vector else _vector(spark, d), V.NOW, V.index(spark, d, vectored=True))


# --- mining ----------------------------------------------------------------------------------------

_LINES = r"string_split_regex(content, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')"


def _line_rows(source: str) -> str:
    return f"ls AS (SELECT * EXCLUDE (x, content), x[2] AS n, {_strip('x[1]')} AS t FROM (SELECT *, unnest(list_zip(l, range(len(l)))) AS x FROM (SELECT *, {_LINES} AS l FROM {source})))"


_PROBLEM = " OR ".join(f"regexp_matches(text, {_quote(p)})" for p in P.PROBLEMS)
_SIGNALS = f"{V.CUED_SQL}, {_line_rows('cued')}, cutl AS (SELECT * EXCLUDE (t), substr(t, 1, 240) AS text FROM ls WHERE length(t) >= 8), signals AS (SELECT * FROM (SELECT *, {_words('text', P.PROBLEM_STOPWORDS)} AS tokens FROM cutl WHERE {_PROBLEM}) WHERE len(tokens) >= 3)"
_DONE = f"{_line_rows('cued')}, done AS (SELECT * FROM (SELECT id, n, project, timestamp, t AS text, {_words('t', P.TODO_STOPWORDS)} AS tokens FROM ls WHERE length(t) >= 8 AND regexp_matches(t, {_quote(P.DONE)})) WHERE len(tokens) > 0)"


@query(f"WITH {_SIGNALS} SELECT id, n, text FROM signals")
def problem_lines(spark, d):
    return mining.problem_signals(V.cued(spark, d)).select("id", F.col("n").cast("long").alias("n"), "text")


@query(f"WITH {_SIGNALS} SELECT id, array_to_string(tokens, ' ') AS fingerprint FROM signals")
def fingerprints(spark, d):
    return mining.fingerprints(mining.problem_signals(V.cued(spark, d))).select("id", "fingerprint")


@query(f"WITH RECURSIVE {_SIGNALS}, {_fold('signals', 0.5)} SELECT id, pos, text FROM kept")
def problems_distinct_in_chunk(spark, d):
    return mining.distinct_in_chunk(mining.problem_signals(V.cued(spark, d)), 0.5).select("id", F.col("n").cast("long").alias("pos"), "text")


@query(f"WITH {_SIGNALS}, p AS (SELECT id, n, tokens, lead(tokens) OVER (PARTITION BY project ORDER BY timestamp, id, n) AS after FROM signals) SELECT id, n, round({_jaccard('tokens', 'after')}, 9) AS j FROM p WHERE after IS NOT NULL")
def jaccard_pairs(spark, d):
    rows = mining.problem_signals(V.cued(spark, d))
    rows = rows.withColumn("after", F.lead("tokens").over(Window.partitionBy("project").orderBy("timestamp", "id", "n"))).where("after IS NOT NULL")
    return rows.select("id", F.col("n").cast("long").alias("n"), F.round(T.jaccard(F.col("tokens"), F.col("after")), 9).alias("j"))


def _clusters(signals: str, threshold: float) -> str:
    """CTEs after `signals` (id, n, session_id, text, tokens, timestamp): linked are the best 20 clusters that are met in three sessions."""
    return f"""prints AS (SELECT DISTINCT array_to_string(tokens, ' ') AS k, tokens FROM {signals}),
linkrows AS (SELECT a.k AS a, b.k AS b FROM prints a JOIN prints b ON {_jaccard("a.tokens", "b.tokens")} >= {threshold}),
reach AS (SELECT a AS k, a AS r FROM linkrows UNION SELECT reach.k, linkrows.b FROM reach JOIN linkrows ON reach.r = linkrows.a),
roots AS (SELECT k AS root_of, min(r) AS cluster FROM reach GROUP BY k),
told AS (SELECT s.*, cluster FROM {signals} s JOIN roots ON root_of = array_to_string(tokens, ' ')),
linked AS (SELECT cluster, arg_min(text, (timestamp, id, n)) AS example, count(DISTINCT session_id)::INTEGER AS session_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS signals
  FROM told GROUP BY cluster HAVING session_count >= 3 ORDER BY session_count DESC, last_seen DESC, cluster LIMIT 20)"""


_CLUSTER_COLUMNS = ("cluster", "example", "session_count", "first_seen", "last_seen", "signals")


@query(f"WITH RECURSIVE {_SIGNALS}, {_fold('signals', 0.5)}, {_clusters('kept', 0.5)} SELECT {', '.join(_CLUSTER_COLUMNS)} FROM linked")
def recurring_clusters(spark, d):
    return mining.recurring_problems(V.cued(spark, d)).select(*_CLUSTER_COLUMNS)


def _extracts(patterns, stop, most: int) -> str:
    """CTE items: id, n, m, body, tokens of every match in the order of the patterns."""
    parts = []
    for p in patterns:
        two = p.count("(") - p.count("(?") == 2
        body = f"regexp_extract_all(content, {_quote(p)}, 1)"
        if two:
            body = f"list_transform(list_zip({body}, regexp_extract_all(content, {_quote(p)}, 2)), lambda x: concat_ws(' ', nullif(x[1], ''), nullif(x[2], '')))"
        parts.append(f"list_zip(regexp_extract_all(content, {_quote(p)}, 0), {body})")
    return f"""matches AS (SELECT id, session_id, project, source, timestamp, unnest(list_zip(l, range(len(l)))) AS x FROM (SELECT *, flatten([{", ".join(parts)}]) AS l FROM cued)),
bodies AS (SELECT * EXCLUDE (x), x[2] AS n, x[1][1] AS m, {_strip("x[1][2]")} AS b FROM matches),
cutb AS (SELECT * EXCLUDE (b), CASE WHEN length(b) > {most} THEN rtrim(substr(b, 1, {most})) || '…' ELSE b END AS body FROM bodies WHERE b <> ''),
items AS (SELECT * FROM (SELECT *, {_words("body", stop)} AS tokens FROM cutb) WHERE len(tokens) >= 2)"""


_TODO_KEPT = f"{V.CUED_SQL}, {_extracts(P.TODOS, P.TODO_STOPWORDS, 200)}, {_fold('items', 0.7)}"
_SHOWN_TODO = _strip(r"regexp_replace(body, '^[\s,;:-]+', '')")


@query(f"WITH RECURSIVE {_TODO_KEPT} SELECT id, pos, {_SHOWN_TODO} AS text FROM kept")
def todo_extract(spark, d):
    return mining.todos(V.cued(spark, d)).select("id", F.col("n").cast("long").alias("pos"), "text")


@query(f"WITH {V.CUED_SQL}, {_DONE} SELECT id, n, text FROM done")
def done_signals(spark, d):
    return mining.done_signals(V.cued(spark, d)).select("id", F.col("n").cast("long").alias("n"), "text")


_RESOLVED = f"""WITH RECURSIVE {_TODO_KEPT}, {_DONE}, first AS (
  SELECT k.id, k.pos, min((d.timestamp, d.id)) AS x FROM kept k JOIN done d ON d.project = k.project AND d.timestamp > k.timestamp AND {_jaccard("k.tokens", "d.tokens")} >= 0.4 GROUP BY k.id, k.pos)"""


@query(f"{_RESOLVED} SELECT kept.id, kept.pos, x IS NOT NULL AS resolved, x[2] AS resolved_by, x[1] AS resolved_at FROM kept LEFT JOIN first USING (id, pos)")
def todo_resolution(spark, d):
    rows = V.cued(spark, d)
    out = mining.resolved_todos(mining.todos(rows), mining.done_signals(rows))
    return out.select("id", F.col("n").cast("long").alias("pos"), "resolved", "resolved_by", "resolved_at")


@query(f"{_RESOLVED} SELECT kept.id, kept.pos FROM kept LEFT JOIN first USING (id, pos) WHERE x IS NULL ORDER BY timestamp DESC, id, pos LIMIT 50")
def todo_open_newest(spark, d):
    rows = V.cued(spark, d)
    out = mining.latest_todos(mining.resolved_todos(mining.todos(rows), mining.done_signals(rows)))
    return out.select("id", F.col("n").cast("long").alias("pos"))


@query(f"{_RESOLVED} SELECT project, count(*) FILTER (x IS NULL) AS open_items, count(*) FILTER (x IS NOT NULL) AS resolved_items FROM kept LEFT JOIN first USING (id, pos) GROUP BY project")
def todo_counts(spark, d):
    rows = V.cued(spark, d)
    return surfaces.todo_counts(mining.resolved_todos(mining.todos(rows), mining.done_signals(rows)))


@query(
    f"""{_RESOLVED}, o AS (SELECT kept.*, x FROM kept LEFT JOIN first USING (id, pos) ORDER BY timestamp DESC, id, pos LIMIT 50)
SELECT id, pos, '- [' || CASE WHEN x IS NULL THEN 'open' ELSE 'done' END || '] [' || project || ' · ' || source || ' · ' || substr(timestamp, 1, 10) || '] ' || {_SHOWN_TODO}
  || CASE WHEN x IS NULL THEN '' ELSE chr(10) || '    resolved ' || substr(x[1], 1, 10) || ' (' || x[2] || ')' END AS line FROM o"""
)
def todo_lines(spark, d):
    rows = V.cued(spark, d)
    out = surfaces.todo_lines(mining.resolved_todos(mining.todos(rows), mining.done_signals(rows)))
    return out.select("id", F.col("n").cast("long").alias("pos"), "line")


_SHOWN_RULE = f"(CASE WHEN trim(rtrim({_strip('CASE WHEN instr(m, body) > 0 THEN substr(m, 1, instr(m, body) - 1) ELSE m END')}, ':')) <> '' THEN rtrim({_strip('CASE WHEN instr(m, body) > 0 THEN substr(m, 1, instr(m, body) - 1) ELSE m END')}, ':') || ' ' || body ELSE body END)"


@query(f"WITH RECURSIVE {V.CUED_SQL}, {_extracts(P.RULES, P.RULE_STOPWORDS, 180)}, {_fold('items', 0.7)} SELECT id, pos, {_SHOWN_RULE} AS text FROM kept")
def rule_extract(spark, d):
    return mining.rules(V.cued(spark, d)).select("id", F.col("n").cast("long").alias("pos"), "text")


@query(f"WITH RECURSIVE {V.CUED_SQL}, {_extracts(P.RULES, P.RULE_STOPWORDS, 180)}, {_fold('items', 0.7)}, shown AS (SELECT * EXCLUDE (n), pos AS n, {_SHOWN_RULE} AS text FROM kept), {_fold('shown', 0.4).replace('seq', 'seq2').replace('fold', 'fold2').replace('kept', 'kept2').replace(' AS pos', ' AS pos2')}, {_clusters('kept2', 0.4)} SELECT {', '.join(_CLUSTER_COLUMNS)} FROM linked")
def rule_clusters(spark, d):
    return mining.recurring_rules(V.cued(spark, d)).select(*_CLUSTER_COLUMNS)


def _decision_sql(source: str = "cued") -> str:
    starts = []
    for p in P.DECISIONS:
        marked = f"string_split(regexp_replace(content, {_quote('(' + p + ')')}, chr(1) || chr(92) || '1', 'g'), chr(1))"
        starts.append(f"list_transform(range(1, len({marked})), lambda i: length(array_to_string({marked}[1:i], '')))")
    return f"""spots AS (SELECT * EXCLUDE (x), x[2] AS n, x[1] AS p FROM (SELECT *, unnest(list_zip(l, range(len(l)))) AS x FROM (SELECT *, flatten([{", ".join(starts)}]) AS l FROM {source}))),
sent AS (SELECT *, {_strip("string_split(substr(content, 1, p), '. ')[-1] || CASE WHEN instr(substr(content, p + 1), '. ') > 0 THEN substr(content, p + 1, instr(substr(content, p + 1), '. ')) ELSE substr(content, p + 1) END")} AS s FROM spots),
capped AS (SELECT *, CASE WHEN length(s) > 300 THEN substr(s, 1, 300) || '...' ELSE s END AS text FROM sent WHERE s <> '')"""


def _decision_query(key: int, over: str) -> str:
    return f"WITH {V.CUED_SQL}, {_decision_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY {over}substr(lower(text), 1, {key}) ORDER BY timestamp, id, n) AS r FROM capped) SELECT id, text FROM r WHERE r = 1"


@query(_decision_query(100, "session_id, "))
def decision_extract(spark, d):
    return mining.decisions(V.cued(spark, d)).select("id", "text")


@query(_decision_query(80, ""))
def decision_mining(spark, d):
    """All chunks are looked at, and sentences that begin alike are told once."""
    rows = mining.decisions(V.cued(spark, d).withColumn("session_id", F.lit("")), key=80)
    return rows.select("id", "text")


@query(f"WITH {V.CUED_SQL}, {_decision_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, substr(lower(text), 1, 100) ORDER BY timestamp, id, n) AS r FROM capped) SELECT id, '- **' || project || '** (' || source || ', ' || substr(timestamp, 1, 10) || '): ' || text AS line FROM r WHERE r = 1")
def decision_lines(spark, d):
    return surfaces.decision_lines(mining.decisions(V.cued(spark, d))).select("id", "line")


def _found_decisions(ranked: str) -> str:
    return f"{ranked}, {_decision_sql('hit')}, r AS (SELECT *, row_number() OVER (PARTITION BY substr(lower(text), 1, 80) ORDER BY rank, n) AS r FROM capped) SELECT id, rank, text FROM r WHERE r = 1"


@query(_found_decisions(f"WITH {_vectored_sql('cued')}, hit AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM vectored QUALIFY rank <= 30)"))
def decisions_by_meaning(spark, d):
    out = surfaces.mined_decisions(_vectored(spark, d, V.cued), _vector(spark, d))
    return out.select("id", F.col("rank").cast("long").alias("rank"), "text")


@query(_found_decisions(f"WITH {_hybrid(50, query='the to', rows='cued')}, hit AS (SELECT cued.*, row_number() OVER (ORDER BY score DESC, sr NULLS LAST, kr NULLS LAST) AS rank FROM fused JOIN cued USING (id))"))
def decisions_by_search(spark, d):
    out = surfaces.mined_decisions(_vectored(spark, d, V.cued), _vector(spark, d), "hybrid", query="the to")
    return out.select("id", F.col("rank").cast("long").alias("rank"), "text")


@query(
    f"""WITH {V.EXCHANGES_SQL}, {_WRITTEN}, e AS (SELECT session_id, source, project, git_branch, started_at, max(timestamp) AS ended_at FROM exchanges GROUP BY ALL),
cued AS (SELECT n::VARCHAR AS id, session_id, project, source, n AS turn, content FROM exchanges), {_decision_sql()},
told AS (SELECT session_id, list('- ' || text ORDER BY turn, n) AS l FROM (SELECT *, row_number() OVER (PARTITION BY session_id, substr(lower(text), 1, 100) ORDER BY turn, n) AS r FROM capped) WHERE r = 1 GROUP BY session_id)
SELECT session_id, project || '/' || substr(started_at, 1, 10) || '-' || substr(session_id, 1, 8) || '.md' AS path,
  md5(concat_ws(chr(10) || chr(10), concat_ws(chr(10), '---', 'source: ' || source, 'project: ' || project, 'date: ' || substr(started_at, 1, 10), 'session_id: ' || session_id, 'branch: ' || nullif(git_branch, ''), '---'),
    '# ' || source || ' — ' || project || CASE WHEN git_branch <> '' THEN ' (' || git_branch || ')' ELSE '' END || chr(10) || '*' || started_at || ' → ' || ended_at || '*', chr(10) || '## Summary' || chr(10) || 'x' || chr(10),
    chr(10) || '## Key Decisions' || chr(10) || array_to_string(l[1:10], chr(10)) || chr(10), '## Transcript', nullif(transcript, ''))) AS note
FROM e JOIN written USING (session_id) LEFT JOIN told USING (session_id)"""
)
def session_notes(spark, d):
    rows = V.exchanges(spark, d)
    notes = surfaces.session_notes(rows, rows.select("session_id").distinct().withColumn("summary", F.lit("x")))
    return notes.select("session_id", "path", F.md5("note").alias("note"))


# --- statistics and archive ------------------------------------------------------------------------


@query(f"WITH {V.CHUNKS_SQL} SELECT project AS name, count(*) AS chunks, count(DISTINCT session_id) AS sessions FROM chunks GROUP BY project")
def stats_by_project(spark, d):
    return lifecycle.stats(V.chunks(spark, d)).where("kind = 'project'").drop("kind")


@query(f"WITH {V.CHUNKS_SQL} SELECT source AS name, count(*) AS chunks, count(DISTINCT session_id) AS sessions FROM chunks GROUP BY source")
def stats_by_source(spark, d):
    return lifecycle.stats(V.chunks(spark, d)).where("kind = 'source'").drop("kind")


@query(
    f"""WITH {V.CHUNKS_SQL}, p AS (SELECT project, count(*) AS n FROM chunks GROUP BY project ORDER BY n DESC, project LIMIT 5)
SELECT count(DISTINCT session_id) AS sessions, count(*) AS chunks, count(DISTINCT source) AS sources, (SELECT string_agg(project || ' (' || n || ')', ', ' ORDER BY n DESC, project) FROM p) AS projects FROM chunks"""
)
def wake_up(spark, d):
    return lifecycle.wake_up(V.chunks(spark, d))


CUTOFF = "2024-09-01T00:00:00"
_ROLLUP = f"""{V.CHUNKS_SQL}, sessions AS (
  SELECT session_id, min(timestamp) AS min_ts, max(timestamp) AS max_ts, arg_min(project, chunk_index) AS project, arg_min(source, chunk_index) AS source, arg_min(git_branch, chunk_index) AS git_branch,
         count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars, false AS archived FROM chunks GROUP BY session_id), old AS (SELECT * FROM sessions WHERE max_ts < '{CUTOFF}')"""


def _short(x: str) -> str:
    return _strip(f"replace(substr({x}, 1, 200), chr(10), ' ')")


_CONDENSED = f"""{_ROLLUP}, ends AS (SELECT session_id, arg_min(content, chunk_index) AS head, arg_max(content, chunk_index) AS tail, string_agg(content, ' ' ORDER BY chunk_index) AS text FROM chunks JOIN old USING (session_id) GROUP BY session_id),
{_top_words("ends", "session_id", "text", 8)},
short AS (SELECT *, {_short("head")} AS o, {_short("tail")} AS c, substr(min_ts, 1, 10) AS d1, substr(max_ts, 1, 10) AS d2 FROM old JOIN ends USING (session_id) LEFT JOIN top USING (session_id)),
condensed AS (SELECT session_id || '-archived' AS id, session_id, project, min_ts AS timestamp, concat_ws(chr(10), '[ARCHIVED session ' || session_id || '] ' || n_chunks || ' chunks, ' || d1 || CASE WHEN d1 <> d2 THEN ' → ' || d2 ELSE '' END || ' · project ' || project,
  CASE WHEN len(keywords) > 0 THEN 'Topics: ' || array_to_string(keywords, ', ') END, CASE WHEN o <> '' THEN 'Opened with: ' || o || '…' END, CASE WHEN c <> '' AND c <> o THEN 'Closed with: ' || c || '…' END) AS content FROM short)"""


@query(f"WITH {_ROLLUP} SELECT * FROM sessions")
def session_rollup(spark, d):
    return lifecycle.rollup(V.chunks(spark, d))


@query(f"WITH {_ROLLUP} SELECT session_id, max_ts FROM old")
def archive_candidates(spark, d):
    return lifecycle.candidates(V.chunks(spark, d), CUTOFF).select("session_id", "max_ts")


@query(f"WITH {_CONDENSED} SELECT id, content, timestamp FROM condensed")
def archive_condense(spark, d):
    rows = V.chunks(spark, d)
    return lifecycle.condensed(rows, lifecycle.candidates(rows, CUTOFF)).select("id", "content", "timestamp")


@query(f"WITH {_CONDENSED} SELECT id, session_id, project FROM chunks WHERE session_id NOT IN (SELECT session_id FROM old) UNION ALL SELECT id, session_id, project FROM condensed")
def archive_rewrite(spark, d):
    return lifecycle.archived(V.chunks(spark, d), CUTOFF).select("id", "session_id", "project")


@query(f"WITH {_CONDENSED} SELECT count(*) AS sessions_archived, sum(n_chunks)::BIGINT AS chunks_before, count(*) AS chunks_after, sum(n_chars)::BIGINT AS chars_before, (SELECT sum(length(content))::BIGINT FROM condensed) AS chars_after FROM old")
def archive_stats(spark, d):
    return lifecycle.archive_stats(V.chunks(spark, d), CUTOFF)


@query(
    f"""WITH {_CONDENSED}, every AS (SELECT session_id, bool_or(ends_with(id, '-archived')) AS done FROM chunks WHERE coalesce(session_id, '') <> '' GROUP BY session_id)
    SELECT (SELECT count(*) FROM every) AS sessions_considered, count(*) AS sessions_archived, (SELECT count(*) FROM every WHERE done) AS sessions_already_archived, coalesce(sum(n_chunks), 0)::BIGINT AS chunks_removed,
      count(*) AS chunks_added, coalesce(sum(n_chars), 0)::BIGINT AS bytes_before, (SELECT coalesce(sum(length(content)), 0)::BIGINT FROM condensed) AS bytes_after FROM old"""
)
def archive_counters(spark, d):
    return lifecycle.archive_counters(V.chunks(spark, d), CUTOFF)


# --- event-like rows -------------------------------------------------------------------------------


@query(f"WITH {V.EXCHANGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, left({_strip('content')}, 200) ORDER BY n) AS r FROM exchanges WHERE role = 'human') SELECT session_id, n FROM r WHERE r = 1")
def user_dedup_prefix(spark, d):
    from lorekiln.sources.parsing import distinct_user_turns

    return distinct_user_turns(V.exchanges(spark, d)).where("role = 'human'").select("session_id", "n")


@query(f"WITH {V.EXCHANGES_SQL} SELECT session_id, n, last_value(CASE WHEN role = 'assistant' THEN n END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY n) AS owner FROM exchanges")
def attach_to_last_assistant(spark, d):
    from lorekiln.sources.parsing import last_assistant

    return V.exchanges(spark, d).select("session_id", "n", last_assistant("session_id", "n").alias("owner"))


@query("SELECT event_id, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM events")
def sessionize_headers(spark, d):
    from lorekiln.sources.parsing import running_session

    return V.table(spark, d, "events").select("event_id", running_session(F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"]).alias("session"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def incremental_events(spark, d):
    return V.table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, t AS last, k, true AS passed FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.t - w.last >= 3600000000 THEN e.t ELSE w.last END, e.k, e.t - w.last >= 3600000000 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT event_id FROM w WHERE passed"""
)
def throttle_events(spark, d):
    from lorekiln.streaming.jobs import throttled

    return throttled(V.table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3600).select("event_id")


# with five paths the bound on an owner's state is never met, nor does forgetting tell: tests hold both against a loop
@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE value >= 5),
w AS (SELECT user_id, event_type, event_id, t AS last, k, true AS passed FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_type, e.event_id, CASE WHEN e.t - w.last >= 86400000000 THEN e.t ELSE w.last END, e.k, e.t - w.last >= 86400000000 FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.event_type = w.event_type AND e.k = w.k + 1)
SELECT user_id AS owner, event_id AS request, event_type AS path FROM w WHERE passed AND event_type <> ''"""
)
def file_requests(spark, d):
    from lorekiln.streaming.requests import answered

    asked = V.table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("request"), F.col("event_type").alias("path"), F.col("ts").alias("at"), F.when(F.col("value") >= 5, "").alias("block"))
    return answered(asked, seconds=86400).select("owner", "request", "path")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def log_prune(spark, d):
    return lifecycle.recent(V.table(spark, d, "events"), 1000, F.desc("ts"), F.desc("event_id")).select("event_id")
