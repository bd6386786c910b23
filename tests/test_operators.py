import math
import random

import pytest

from lorekiln.operators import linking
from pyspark.sql import functions as F

from lorekiln.operators import ingest, lifecycle, linking, mining, search

CHUNK = "id string, session_id string, project string, source string, git_branch string, content string, timestamp string, chunk_index int"


def chunks(spark, *rows):
    full = []
    for k, r in enumerate(rows):
        d = {"id": f"k{k:03}", "session_id": "s1", "project": "p", "source": "a", "git_branch": "main", "content": "", "timestamp": f"2024-01-{k % 28 + 1:02}", "chunk_index": k} | r
        full.append(tuple(d[x.split()[0]] for x in CHUNK.split(", ")))
    return spark.createDataFrame(full, CHUNK)


def exchanges(spark, turns, branch="main"):
    rows = [("s", "src", "proj", branch, "2024-01-01T00:00:00Z", n, role, text, time, tools) for n, (role, text, time, tools) in enumerate(turns)]
    return spark.createDataFrame(rows, "session_id string, source string, project string, git_branch string, started_at string, n long, role string, content string, timestamp string, tools array<string>")


def test_chunks_close_on_overflow_and_take_that_turns_time(spark):
    turns = [("system", "x" * 5000, "", []), ("human", "a" * 400, "t1", []), ("assistant", "b" * 400, "t2", ["Read"]), ("human", "c" * 4000, "t3", []), ("assistant", "d" * 40, "", [])]
    out = ingest.chunks(exchanges(spark, turns), 250).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in out] == [0, 1, 2]
    assert [r.timestamp for r in out] == ["t3", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z"]
    assert out[0].content.startswith("[src] Project: proj | Branch: main | 2024-01-01T00:00:00Z\n\n**User**: aaa")
    assert out[0].content.endswith("b\n[Tools used: Read]")
    assert "Branch" not in ingest.chunks(exchanges(spark, turns, None), 250).orderBy("chunk_index").first().content
    assert ingest.chunks(exchanges(spark, turns[:1])).count() == 0


def test_summary(spark):
    out = ingest.summaries(exchanges(spark, [("human", "parser bug in parser", "", []), ("assistant", "ok", "", ["Edit", "Bash"]), ("system", "s", "", [])])).first()
    assert out.summary == "2 exchanges. about parser, bug. Tools: Bash, Edit."


def test_first_write_wins(spark, tmp_path):
    one = chunks(spark, {"id": "a", "content": "old"}, {"id": "b"})
    path = str(tmp_path / "store")
    assert ingest.append(one, path) == 2
    assert ingest.append(chunks(spark, {"id": "a", "content": "new"}, {"id": "c"}, {"id": "c"}), path) == 1
    assert spark.read.parquet(path).where("id = 'a'").first().content == "old"
    assert {r.id for r in ingest.new_rows(chunks(spark, {"id": "a", "content": "new"}, {"id": "b"}), one, refresh=True).collect()} == {"a"}


def test_keyword_search_equals_sqlite(spark):
    import sqlite3

    rnd = random.Random(1)
    words = ["cache", "Café", "parser", "jwt.py", "snake_case", "a-b", "über", "x1", "the", "the", "the"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, id UNINDEXED, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f VALUES (?, ?)", [(t, f"k{k:03}") for k, t in enumerate(texts)])
    df = chunks(spark, *[{"content": t} for t in texts])
    for query in ("cafe", "parser cache", "jwt.py", "snake_case ... x1", "the", "the the", "CASE", "nothing"):
        compiled = " ".join(f'"{t}"' for t in query.split())
        want = dict(db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (compiled,)).fetchall())
        got = {r.id: r.bm25 for r in search.keyword_scores(df, query).collect()}
        assert got.keys() == want.keys(), query
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got), query
    some = {r.id: r.bm25 for r in search.keyword_scores(df, "cafe", project="other").collect()}
    assert some == {} and search.keyword(df, "  ").count() == 0 and search.keyword(df, "...").count() == 0


def vectored(spark, rows):
    return chunks(spark, *[{"id": i, "content": c} for i, c, _ in rows]).join(spark.createDataFrame([(i, v) for i, _, v in rows], "id string, embedding array<float>"), "id")


def test_hybrid_search(spark):
    rows = vectored(spark, [("a", "cache miss", [1.0, 0.0]), ("b", "other words", [0.9, 0.1]), ("c", "cache cache", [0.0, 1.0]), ("d", "none", [-1.0, 0.0])])
    out = {r.id: (r.sem_score, r.kw_score, r.score) for r in search.hybrid(rows, "cache", [1.0, 0.0], 4).collect()}
    assert out["a"][0] == 1.0 and out["c"][1] == 1.0 and out["a"][1] == 0.0 and out["d"] == (0.0, 0.0, 0.0)
    lone = search.hybrid(rows, "other", [1.0, 0.0], 4, min_relevance=0.95).collect()
    assert {r.id for r in lone} == {"a", "b"} and {r.id: r.kw_score for r in lone}["b"] == 1.0
    # only a keyword hit passes below the relevance bound, and its distance is unknown
    only = {r.id: r.distance for r in search.hybrid(rows, "none", [1.0, 0.0], 4, min_relevance=0.95).collect()}
    assert only["d"] is None
    assert search.search(rows, "cache", mode="keyword").first().distance is None
    with pytest.raises(ValueError):
        search.search(rows, "x", mode="no")


def test_decay_orders_keyword_hits_by_time(spark):
    rows = chunks(spark, {"id": "old", "content": "cache", "timestamp": "2024-01-01T00:00:00Z"}, {"id": "new", "content": "cache x y z", "timestamp": "2024-05-01T00:00:00Z"}, {"id": "odd", "content": "cache", "timestamp": "?"})
    out = search.search(rows, "cache", mode="keyword", now="2024-05-31T00:00:00").collect()
    assert [r.id for r in out] == ["odd", "new", "old"]
    assert math.isclose(out[1].decayed, 0.5 * math.exp(-1))


def test_bounds():
    assert search.checked("q", top_k="x")[3] == 5 and search.checked("q", top_k=99)[3] == 50 and search.checked("q", top_k=None)[3] == 5
    with pytest.raises(ValueError):
        search.checked("q" * 10_001)


def test_todos_and_their_resolution(spark):
    df = chunks(
        spark,
        {"id": "a", "content": "TODO: update the parser cache.", "timestamp": "2024-01-02"},
        {"id": "b", "content": "fixed the parser cache update", "timestamp": "2024-01-01"},
        {"id": "c", "content": "fixed parser cache update", "timestamp": "2024-01-05", "project": "other"},
        {"id": "d", "content": "we shipped the parser cache update\nmore", "timestamp": "2024-01-04"},
        {"id": "e", "content": "done with parser cache update", "timestamp": "2024-01-03"},
        {"id": "f", "content": "TODO: fix the broken reader\nnext line. more"},
        {"id": "g", "content": "FIXME: write reader docs! TODO: write the reader docs."},
    )
    found = mining.todos(df)
    texts = {(r.id, r.text) for r in found.collect()}
    assert texts == {("a", "update the parser cache"), ("g", "write the reader docs")}  # patterns go first; f ends in no mark
    out = {r.id: (r.resolved, r.resolved_by) for r in mining.resolved_todos(found, mining.done_signals(df)).collect()}
    assert out["a"] == (True, "e") and out["g"] == (False, None)


def test_rules(spark):
    df = chunks(spark, {"content": "Please don't commit generated files. use spaces instead of tabs here. prefer composition over inheritance"})
    assert [r.text for r in mining.rules(df).orderBy("n").collect()] == ["Please don't commit generated files", "use spaces instead of tabs here. spaces  of tabs here"]  # two groups don't stand together in the match: all of it leads


def test_decisions(spark):
    df = chunks(spark, {"content": "First. We decided to use parquet. Then chose redis over x. We decided to use parquet. e"}, {"content": "We decided to use parquet.", "session_id": "s2"})
    out = [(r.session_id, r.text) for r in mining.decisions(df).orderBy("id", "n").collect()]
    assert out == [("s1", "We decided to use parquet."), ("s1", "Then chose redis over x."), ("s2", "We decided to use parquet.")]


def greedy(signals, threshold):
    groups = []
    for r in signals:
        best, score = None, 0
        for g in groups:
            s = len(g[0] & set(r.tokens)) / len(g[0] | set(r.tokens))
            if s >= threshold and s > score:
                best, score = g, s
        if best is None:
            groups.append(best := [set(), []])
        best[0].update(r.tokens)
        best[1].append(r.id)
    return groups


def _signals(spark, seed, size, n=150):
    rnd = random.Random(seed)
    words = "timeout worker pool parser null config login upgrade socket driver".split()
    df = chunks(spark, *[{"content": "error " + " ".join(rnd.sample(words, rnd.choice(size))), "session_id": f"s{rnd.randint(0, 30)}" if k % 9 else ""} for k in range(n)])
    return df, mining.distinct_in_chunk(mining.problem_signals(df), 0.5)


def test_walked_clusters_equal_a_plain_walk(spark):
    _, signals = _signals(spark, 3, [4])
    rows = sorted(signals.collect(), key=lambda r: (r.timestamp, r.id, r.n))
    want = [len(ids) for _, ids in greedy(rows, 0.5)]
    out = mining.walked_clusters(signals, 0.5, min_sessions=0, top=1000).orderBy("cluster").collect()
    assert [r.signals for r in out] == want
    assert mining.walked_clusters(signals.where("false"), 0.5).count() == 0


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.8])
def test_clusters_are_what_links_reach(spark, threshold):
    _, signals = _signals(spark, 4, [2, 3, 4, 6], 90)
    rows = signals.collect()
    sets = {" ".join(r.tokens): set(r.tokens) for r in rows}
    alike = lambda a, b: len(a & b) / len(a | b) >= threshold
    links = {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])}
    prints = signals.select(F.array_join("tokens", " ").alias("fingerprint"), "tokens").distinct()
    assert {tuple(r) for r in linking.links(prints, threshold).collect()} == links
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    told = mining.members(signals, threshold)
    assert {(r.id, r.n): r.cluster for r in told.collect()} == {(r.id, r.n): root[" ".join(r.tokens)] for r in rows}
    out = mining.clusters(signals, threshold, min_sessions=1, top=1000).collect()
    by = {c: [r for r in rows if root[" ".join(r.tokens)] == c] for c in set(root.values())}
    sessions = {c: len({r.session_id for r in x} - {""}) for c, x in by.items()}
    assert {r.cluster for r in out} == {c for c in by if sessions[c]}
    for r in out:
        mine = by[r.cluster]
        assert (r.session_count, r.signals, r.fingerprint) == (sessions[r.cluster], len(mine), " ".join(sorted(set().union(*(x.tokens for x in mine)))))
        assert r.example == min(mine, key=lambda x: (x.timestamp, x.id, x.n)).text and r.projects == sorted({x.project for x in mine} - {""})
    assert [(-r.session_count, r.cluster) for r in out] == sorted((-r.session_count, r.cluster) for r in out) or len({r.last_seen for r in out}) > 1
    assert mining.clusters(signals.where("false"), threshold).count() == 0


def test_archiving(spark):
    df = chunks(
        spark,
        {"id": "a0", "session_id": "a", "content": "parser parser start", "timestamp": "2023-01-01T10"}, {"id": "a1", "session_id": "a", "content": "the end", "timestamp": "2023-01-02T10"},
        {"id": "b0", "session_id": "b", "timestamp": "2024-06-01"}, {"id": "c-archived", "session_id": "c", "timestamp": "2020-01-01"}, {"id": "c0", "session_id": "c", "timestamp": "2020-01-01"}, {"id": "d0", "session_id": "d", "timestamp": "2024-01-01"}, {"id": "e0", "session_id": "e", "timestamp": ""},
    )
    out = {r.id: r for r in lifecycle.archived(df, "2024-01-01").collect()}
    assert set(out) == {"a-archived", "b0", "c-archived", "c0", "d0", "e0"}
    assert out["a-archived"].content == "[ARCHIVED session a] 2 chunks, 2023-01-01 → 2023-01-02 · project p\nTopics: parser, start, end\nOpened with: parser parser start…\nClosed with: the end…"
    again = lifecycle.archived(lifecycle.archived(df, "2024-01-01"), "2024-01-01")
    assert {r.id for r in again.collect()} == set(out)


def test_deletes_and_transcript(spark):
    df = chunks(spark, {"project": "x"}, {"project": "y", "session_id": "s2"})
    assert lifecycle.deleted(df, everything=True, session="s1").count() == 0
    assert lifecycle.deleted(df, project="x", session="s2").first().project == "x"
    turns = [("human", f"m{k}", "", []) for k in range(7)]
    text = lifecycle.transcript(exchanges(spark, turns), ends=2).first().transcript
    assert text.count("###") == 4 and "\n\n---\n\n*[3 exchanges omitted; full content in the store]*\n\n---\n\n" in text and "m2" not in text and "m5" in text
    mixed = [("human", "my password: hunter2hunter2", "", []), ("system", "quiet", "", []), ("assistant", "done", "", ["Read", "Bash"])]
    assert lifecycle.transcript(exchanges(spark, mixed)).first().transcript == "### You\nmy [REDACTED]\n\n---\n\n### Assistant\n> Tools: Read, Bash\ndone"
    assert lifecycle.transcript(exchanges(spark, mixed[1:2])).first().transcript == ""
    assert lifecycle.stats(df).where("kind = 'all'").first().chunks == 2
