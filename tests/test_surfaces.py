import json

import pytest

from lorekiln.operators import index, ingest, lifecycle, search, surfaces
from lorekiln.sources import registry
from tests.test_operators import chunks

TEXTS = ["the red fox of the hill", "of the red the red hill", "blue hill", "", "THE Red, the-red; rot", "fox fox fox red"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [{"id": f"c{k}", "content": TEXTS[k % len(TEXTS)] + f" extra{k}\nline", "project": "ab"[k % 2], "session_id": f"s{k % 4}"} for k in range(24)]
    vectors = spark.createDataFrame([(f"c{k}", [float(k % 5), 1.0, float(k % 3)]) for k in range(24)], "id string, embedding array<double>")
    return chunks(spark, *made).join(vectors, "id")


@pytest.fixture(scope="module")
def path(rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    index.write(rows, at)
    return at


@pytest.mark.parametrize("query", ["red", "the-red", "of-the-red hill", "fox red", "red-the-red", "missing", "... ,", ""])
def test_the_stored_index_finds_what_a_scan_finds(spark, rows, path, query):
    for filters in ({}, {"project": "a"}):
        got = [(r.id, round(r.bm25, 9)) for r in index.keyword(spark, path, query, 9, **filters).collect()]
        assert got == [(r.id, round(r.bm25, 9)) for r in search.keyword(rows, query, 9, **filters).collect()]
    both = [sorted((r.id, round(r.score, 9)) for r in search.hybrid(rows, query or "red", [1.0, 1.0, 0.0], 4, index=i).collect()) for i in (None, path)]
    assert both[0] == both[1]


def test_pages_and_snippets(rows, path):
    one = surfaces.full(rows, "red", [1.0, 1.0, 0.0], index=path)
    found = one.orderBy("place").collect()
    assert [r.place for r in found] == list(range(1, len(found) + 1)) and found
    assert surfaces.page(one).first().page.startswith(f"Found {len(found)} results:\n\n[1] ")
    assert surfaces.page(one.limit(0)).first().page == "No matching results found."
    assert surfaces.session_start(rows, "", [1.0, 1.0, 0.0], "2025-01-01T00:00:00").count() == 0
    assert 0 < surfaces.session_start(rows, "/x/a", [1.0, 1.0, 0.0], "2025-01-01T00:00:00", index=path).count() <= 3
    assert surfaces.terminal(rows, "red", [1.0, 1.0, 0.0], most=10).where("length(text) > 10").count() == 0


def test_prompts_that_ask_for_nothing(rows):
    assert [surfaces.asks(p) for p in ("", "yes", " CONTINUE ", "do it", "red fox", "red fox?!", "continue")] == [False] * 5 + [True, False]
    assert surfaces.prompt_context(rows, "continue", "/x/a", "s0", [1.0, 1.0, 0.0]).count() == 0
    lines = surfaces.prompt_context(rows, "red hill ", "/x/a", "s0", [1.0, 1.0, 0.0]).collect()
    assert 0 < len(lines) <= 3 and all(r.line.startswith("- [a · a · 2024-01-") for r in lines)


def test_notes(spark):
    kind = "session_id string, source string, project string, git_branch string, started_at string, ended_at string, summary string, decisions array<string>, files array<string>, transcript string, working_directory string"
    sessions = [("s/1-long-name", "src", "p x", "main", "2024-01-02T03", "2024-01-03", "Did.", [f"d{k}" for k in range(12)], [f"/w/f{k}" for k in range(22)], "T", "/w"), ("s2", "src", "q", None, None, None, None, [], [], None, None)]
    got = {r.path: r.note for r in surfaces.notes(spark.createDataFrame(sessions, kind)).collect()}
    one, two = (got[p] for p in sorted(got))
    assert sorted(got) == ["p_x/2024-01-02-s_1-long.md", "q/unknown-s2.md"]
    assert one.startswith("---\nsource: src\nproject: p x\ndate: 2024-01-02\nsession_id: s/1-long-name\nbranch: main\nfiles_touched: 22\n---\n\n# src")
    assert "# src — p x (main)\n*2024-01-02T03 → 2024-01-03*" in one and "- d9\n" in one and "d10" not in one and "- `f19`\n- *...and 2 more*" in one
    assert two == "---\nsource: src\nproject: q\ndate: unknown\nsession_id: s2\n---\n\n# src — q\n* → *\n\n## Transcript"


def test_lines_and_counts(spark):
    kind = "id string, n int, project string, source string, timestamp string, text string, resolved boolean, resolved_by string, resolved_at string"
    rows = spark.createDataFrame([("a", 0, "p", "s", "2024-01-01", "x", False, None, None), ("b", 0, "p", "s", "2024-01-03T01", "y", True, "d", "2024-01-05T09"), ("c", 1, None, None, "", "z", False, None, None)], kind)
    assert {r.line for r in surfaces.todo_lines(rows).collect()} == {"- [open] [p · s · 2024-01-01] x", "- [done] [p · s · 2024-01-03] y\n    resolved 2024-01-05 (d)", "- [open] [? · ? · ?] z"}
    assert [r.id for r in surfaces.todo_lines(rows, 2).collect()] == ["b", "a"]
    assert sorted((r.project or "", r.open_items, r.resolved_items) for r in surfaces.todo_counts(rows).collect()) == [("", 1, 0), ("p", 1, 1)]
    assert [r.line for r in surfaces.decision_lines(rows).orderBy("id").collect()] == ["- **p** (s, 2024-01-01): x", "- **p** (s, 2024-01-03): y", "- **?** (?, ?): z"]
    met = [(0, "it broke", "broke pool", 3, ["b", "a"], "2024-01-01T1", "2024-02-01T1"), (1, "e", "f", 4, [], "", "")]
    met = spark.createDataFrame(met, "cluster int, example string, fingerprint string, session_count int, projects array<string>, first_seen string, last_seen string")
    assert [r.line for r in surfaces.cluster_lines(met).orderBy("cluster").collect()] == ["- [3 sessions, 2024-01-01 → 2024-02-01, a, b] it broke\n    fingerprint: broke pool", "- [4 sessions, ?, ?] e\n    fingerprint: f"]
    assert surfaces.cluster_lines(met, told=False).where("cluster = 1").first().line == "- [4 sessions, ?, ?] e"


def test_projects_come_back_as_they_were(spark, tmp_path):
    path = str(tmp_path / "store")
    names = ["007", "2024", "2024-01-01", "", None, "a=b/c", "p"]
    assert ingest.append(chunks(spark, *({"id": f"i{k}", "project": p} for k, p in enumerate(names[:4]))), path) == 4
    assert ingest.append(chunks(spark, *({"id": f"i{k}", "project": p} for k, p in enumerate(names))), path) == 3
    out = ingest.stored(spark, path, chunks(spark, {}).schema)
    assert {r.id: r.project for r in out.collect()} == {f"i{k}": p for k, p in enumerate(names)}
    twice = chunks(spark, {"id": "t", "content": "late", "timestamp": "2024-02-01"}, {"id": "t", "content": "early", "timestamp": "2024-01-01"})
    assert ingest.append(twice, path) == 1
    assert ingest.stored(spark, path, twice.schema).where("id = 't'").first().content == "early"


def test_injection_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"2024-01-01T00:{k // 60:02}:{k % 60:02}", f"prompt {k}", "p", "s", ["a"]) for k in range(50)]
    lifecycle.log_injections(spark.createDataFrame(rows, lifecycle.INJECTION), path)
    with open(f"{path}/part-broken.json", "w") as f:
        f.write("{not json\n" + json.dumps({"timestamp": "2025", "prompt": "last", "chunk_ids": []}) + "\n")
    assert lifecycle.injections(spark, path).count() == 51
    assert lifecycle.pruned_injections(spark, path).count() == 51
    assert {r.prompt for r in lifecycle.pruned_injections(spark, path, keep=2, least=10).collect()} == {"last", "prompt 49"}


def test_readers_by_name(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"type": "user", "sessionId": "x", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hi there"}}) + "\n")
    found = {n for n, r in registry.READERS.items() if r.detect(spark, str(tmp_path))}
    assert found == {"session-jsonl", "event-jsonl", "prompt-history"}
    assert registry.sessions(spark, {"session-jsonl": str(tmp_path)}).count() == 1
    assert registry.sessions(spark, {"session-jsonl": str(tmp_path)}, since=4e9).count() == 0
    with pytest.raises(ValueError, match="nothing"):
        registry.sessions(spark, {"nothing": "x"})


