import json
import sqlite3

from lorekiln.operators import ingest
from lorekiln.sources import keyvalue, logs, parsing


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def turns(row):
    return [(x.role, x.content, x.timestamp, x.tools) for x in row.exchanges]


def test_session_jsonl(spark, tmp_path):
    say = lambda kind, content, t, **more: {"type": kind, "timestamp": t, "message": {"role": "?", "content": content}, **more}
    put(
        tmp_path / "-Users-me-Code-tool" / "one.jsonl",
        {"type": "permission-mode", "sessionId": ""},
        say("user", "fix it", "2024-01-01T00:00:01Z", sessionId="abc", cwd="/w/proj", gitBranch=""),
        "{bad json",
        say("assistant", [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "/w/b.py"}}, {"type": "text", "text": "two"}], "2024-01-01T00:00:02Z", gitBranch="dev"),
        say("assistant", [{"type": "tool_use", "name": "Edit", "input": {"file_path": "/w/a.py"}}, {"type": "tool_use", "input": {}}], "2024-01-01T00:00:03Z"),
        say("assistant", [], "2024-01-01T00:00:04Z"),
    )
    put(tmp_path / "-Users-me-Code-tool" / "two.jsonl", say("user", "hi", "", sessionId=""))
    put(tmp_path / "-Users-me-Code-tool" / "empty.jsonl", {"type": "summary"})
    put(tmp_path / "x" / "subagents" / "no.jsonl", say("user", "hi", ""))
    out = {r.session_id: r for r in logs.session_jsonl(spark, str(tmp_path)).collect()}
    assert set(out) == {"abc", "two"}
    r = out["abc"]
    assert (r.project, r.git_branch, r.started_at, r.ended_at, r.files) == ("proj", "dev", "2024-01-01T00:00:01Z", "2024-01-01T00:00:04Z", ["/w/a.py", "/w/b.py"])
    assert turns(r) == [("human", "fix it", "2024-01-01T00:00:01Z", []), ("assistant", "one\ntwo", "2024-01-01T00:00:02Z", ["Read"]), ("assistant", "[Used tools: Edit, unknown]", "2024-01-01T00:00:03Z", ["Edit", "unknown"])]
    assert out["two"].project == "tool"
    assert logs.session_jsonl(spark, str(tmp_path), since=4e9).count() == 0
    chunks = ingest.chunks(parsing.exchange_rows(logs.session_jsonl(spark, str(tmp_path))))
    assert chunks.where("session_id = 'abc'").first().content.startswith("[session-jsonl] Project: proj | Branch: dev")


def test_event_jsonl(spark, tmp_path):
    item = lambda role, text, t: {"timestamp": t, "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}}
    put(
        tmp_path / "2024" / "01" / "r.jsonl",
        {"timestamp": "t0", "type": "session_meta", "payload": {"id": "sid", "cwd": "/w/app/", "git": {"branch": "main"}}},
        item("user", "<environment_context>no</environment_context>", "t1"),
        {"timestamp": "t1", "type": "function_call", "payload": {"name": "lost", "arguments": "{}"}},
        item("user", "do this", "t2"),
        {"timestamp": "t3", "type": "event_msg", "payload": {"type": "user_message", "message": " do this "}},
        item("assistant", "did", "t4"),
        "nonsense",
        {"timestamp": "t5", "type": "function_call", "payload": {"name": "shell", "arguments": "{}"}},
        {"timestamp": "t6", "type": "event_msg", "payload": {"type": "user_message", "message": "more"}},
        {"timestamp": "t7", "type": "response_item", "payload": {"type": "function_call", "name": "patch"}},
    )
    (r,) = logs.event_jsonl(spark, str(tmp_path)).collect()
    assert (r.session_id, r.project, r.git_branch, r.started_at, r.ended_at) == ("sid", "app", "main", "t0", "t7")
    assert turns(r) == [("human", "do this", "t2", []), ("assistant", "did", "t4", ["shell", "patch"]), ("human", "more", "t6", [])]


def test_arguments(spark):
    df = spark.createDataFrame([(0, '{"a": 1}'), (1, "bad {"), (2, "[1]")], "i int, c string")
    out = [json.loads(r.o) for r in df.select("i", logs.arguments(df.c).alias("o")).orderBy("i").collect()]
    assert out == [{"a": 1}, {"raw": "bad {"}, {}]


def test_prompt_history(spark, tmp_path):
    put(tmp_path / "history.jsonl", {"input": " one ", "parts": []}, {"input": "  "}, "bad", {"input": "two"})
    (r,) = logs.prompt_history(spark, str(tmp_path)).collect()
    assert (r.session_id, r.project) == ("prompts-history", "general")
    assert [x.content for x in r.exchanges] == ["one", "two"] and r.started_at.endswith("Z")


def test_chat_markdown(spark, tmp_path):
    text = """before
# tool chat started at 2024-01-01 10:00:00

> Model: x
#### first line
####
#### second line

Answer one
```py
x = 1
```
> Applied edit to src/a.py
> Tokens: 1k
#### next
> Applied edit to src/b.py

more prose
# tool chat started at 2024-01-02 11:00:00
#### last
> Applied edit to src/a.py
"""
    path = tmp_path / "proj" / ".tool.chat.history.md"
    put(path, text)
    put(tmp_path / "proj" / "node_modules" / ".tool.chat.history.md", text)
    assert logs.chat_paths(str(tmp_path), ".tool.chat.history.md") == [str(path)]
    (r,) = logs.chat_markdown(spark, [str(path)]).collect()
    one, two = "2024-01-01T10:00:00Z", "2024-01-02T11:00:00Z"
    assert (r.project, r.started_at, r.ended_at, r.files) == ("proj", one, two, ["src/a.py", "src/b.py"])
    assert turns(r) == [
        ("human", "first line\n\nsecond line", one, []), ("assistant", "Answer one\n```py\nx = 1\n```", one, ["edit_file"]), ("human", "next", one, []), ("assistant", "", one, ["edit_file"]), ("assistant", "more prose", one, []),
        ("human", "last", two, []), ("assistant", "", two, ["edit_file"]),
    ]


def test_key_value_database(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "state.vscdb")
    db.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
    chat = {"composerId": "c1", "name": "Name", "createdAt": 1_700_000_000_000, "conversation": [{"type": 1, "text": "hi"}, {"type": 2, "text": "hello", "timestamp": 1_700_000_001_000}, {"type": 3, "text": "x"}, {"type": 1, "text": " "}], "context": {"uri": "/w/other/"}}
    rows = [("composerData:b", chat), ("composerData:c", chat | {"composerId": "c2"}), ("composerData:d", {"composerId": "c3", "headers": ["x" * 100]}), ("other:e", chat)]
    db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(k, json.dumps(v)) for k, v in rows] + [("composerData:s", "short")])
    db.commit()
    projects = spark.createDataFrame([("c1", "mine")], "composer_id string, project string")
    out = {r.session_id: r for r in keyvalue.composer_sessions(spark, str(tmp_path / "state.vscdb"), projects).collect()}
    assert set(out) == {"c1", "c2"}
    assert (out["c1"].project, out["c2"].project, out["c1"].summary, out["c1"].started_at) == ("mine", "other", "Name", "2023-11-14T22:13:20+00:00")
    assert turns(out["c1"]) == [("human", "hi", "2023-11-14T22:13:20+00:00", []), ("assistant", "hello", "2023-11-14T22:13:21+00:00", [])]


def test_large_logs_are_read_in_ranges(spark, tmp_path):
    """A log of many ranges: every line has its number, lines of other bytes than UTF-8 stay, and turns come in the order of the file."""
    import random

    rng = random.Random(5)
    texts = ["x" * rng.choice([0, 1, 7, 900, 9000]) + str(i) for i in range(600)]
    put(tmp_path / "a b+c%20" / "long.jsonl", *({"type": "user" if i % 2 else "assistant", "timestamp": f"t{i:04}", "sessionId": "s", "message": {"content": t}} if i % 10 else "" for i, t in enumerate(texts)))
    put(tmp_path / "a b+c%20" / "short.jsonl", {"type": "user", "timestamp": "t", "message": {"content": "hi"}})
    (tmp_path / "a b+c%20" / "none.jsonl").write_text("")
    (tmp_path / "a b+c%20" / "odd.jsonl").write_bytes(b'\xff\n{"type": "user", "message": {"content": "\xc3\xa9\xff"}}\n')
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = logs.lines(spark, str(tmp_path), "*.jsonl")
        assert rows.where("path LIKE '%long%'").select("block").distinct().count() > 20
        numbers = {}
        for r in logs.numbered(rows).collect():
            numbers.setdefault(r.path.rsplit("/", 1)[1], {})[r.line] = r.raw
        for name, got in numbers.items():
            want = (tmp_path / "a b+c%20" / name).read_bytes().decode(errors="replace").split("\n")
            assert [got[i] for i in range(len(got))] == want[: len(got)] and want[len(got) :] in ([], [""])
        assert set(numbers) == {"long.jsonl", "short.jsonl", "odd.jsonl"}
        out = {r.session_id: r for r in logs.session_jsonl(spark, str(tmp_path)).collect()}
        assert [x.content for x in out["s"].exchanges] == [t for i, t in enumerate(texts) if i % 10]
        assert [x.n for x in out["s"].exchanges] == list(range(540)) and out["odd"].exchanges[0].content == "é�"
        turned = logs.session_turns(spark, str(tmp_path))
        assert [(r.n, r.content, r.started_at) for r in turned.where("session_id = 's'").orderBy("n").collect()] == [(i, t, "t0001") for i, t in enumerate(texts) if i % 10]
        whole = ingest.chunks(parsing.exchange_rows(logs.session_jsonl(spark, str(tmp_path))))
        assert sorted(map(tuple, ingest.chunks(turned).collect())) == sorted(map(tuple, whole.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_unchanged_files_are_not_opened(spark, tmp_path):
    """A file that can't be read ends the job if it is opened; it isn't if it hasn't changed."""
    import os

    import pytest

    put(tmp_path / "new.jsonl", "one", "two")
    (tmp_path / "old.jsonl.gz").write_bytes(b"no archive")
    os.utime(tmp_path / "old.jsonl.gz", (1e9, 1e9))
    with pytest.raises(Exception, match="gzip|GZIP|incorrect header"):
        logs.lines(spark, str(tmp_path), "*.jsonl*").collect()
    assert [r.raw for r in logs.lines(spark, str(tmp_path), "*.jsonl*", since=1e9).collect()] == ["one", "two"]
    assert [r.raw for r in logs.lines(spark, str(tmp_path), "*.jsonl*", without="old.").collect()] == ["one", "two"]


def test_projects_of_chats_come_from_workspaces(spark, tmp_path):
    """Workspaces beside the database tell the project; broken ones tell nothing; a chat that none knows keeps what it says itself."""

    def database(path, table, rows):
        path.parent.mkdir(parents=True, exist_ok=True)
        db = sqlite3.connect(path)
        db.execute(f"CREATE TABLE {table} (key TEXT, value TEXT)")
        db.executemany(f"INSERT INTO {table} VALUES (?, ?)", [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in rows])
        db.commit()
        db.close()

    chat = lambda c: {"composerId": c, "createdAt": 1_700_000_000_000, "conversation": [{"type": 1, "text": "hi there, " * 10}], "context": {"uri": "/w/own"}}
    for user in ("u1", "u2"):
        database(tmp_path / user / "globalStorage" / "state.vscdb", "cursorDiskKV", [(f"composerData:{c}", chat(c)) for c in ("a", "b", "c")])
    here = tmp_path / "u1" / "workspaceStorage"

    def workspace(name, about, value):
        (here / name).mkdir(parents=True)
        (here / name / "workspace.json").write_text(about)
        database(here / name / "state.vscdb", "ItemTable", [("composer.composerData", value)])

    workspace("w1", '{"folder": "file:///home/me/alpha"}', {"allComposers": [{"composerId": "a"}, {"composerId": ""}, {"composerId": 5}, "x"]})
    workspace("w2", '{"folder": "file:///home/me/beta/"}', {"allComposers": [{"composerId": "a"}]})
    workspace("w3", "{bad", {"allComposers": [{"composerId": "b"}]})
    workspace("w4", '{"folder": "/x/gamma"}', "{bad")
    workspace("w5", '["no object"]', {"allComposers": [{"composerId": "b"}]})
    workspace("w6", '{"workspace": "many"}', {"allComposers": [{"composerId": "b"}]})
    (here / "w7").mkdir()
    (here / "file").write_text("x")
    out = {(r.project, r.session_id) for r in keyvalue.composer_sessions(spark, str(tmp_path / "u1")).collect()}
    assert out == {("beta", "a"), ("own", "b"), ("own", "c")}
    # what one user's workspaces say isn't said of another's chats
    out = sorted((r.project, r.session_id) for r in keyvalue.composer_sessions(spark, str(tmp_path)).collect())
    assert out == [("beta", "a"), ("own", "a"), ("own", "b"), ("own", "b"), ("own", "c"), ("own", "c")]
    assert keyvalue.composer_sessions(spark, str(tmp_path / "u2")).where("project = 'own'").count() == 3
