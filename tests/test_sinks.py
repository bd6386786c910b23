"""Files that Spark writes a row each, and documents of many parts."""

import json
import os

import pytest

from lorekiln.sources import sinks

from .test_operators import chunks

KIND = "path string, content string, k string"


def found(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(root) for f in names}


def test_a_file_a_row(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"p{i % 7}/n{i}.md", f"text {i} é", f"{i}") for i in range(60)] + [("p0/twice.md", "first", "a"), ("p0/twice.md", "second", "b"), ("p0/null.md", None, "c"), (None, "nowhere", "d")]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    want = {r[0]: r[1] or "" for r in rows if r[0]}
    for _ in range(2):  # once more changes nothing
        assert sinks.put_files(df, root, "k") == {"written": 62, "replaced": 1}
        assert found(root) == want
        assert {os.stat(os.path.join(root, p)).st_mode & 0o777 for p in want} == {0o600}
        assert sorted(os.listdir(root)) == [f"p{i}" for i in range(7)]
    assert sinks.put_files(df.where("false"), root, "k") == {"written": 0, "replaced": 0}


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    root = str(tmp_path / "notes")
    os.makedirs(root)
    bad = spark.createDataFrame([(f"n{i}.md", "x", "k") for i in range(40)] + [("../out.md", "x", "k")], KIND).repartition(4)
    with pytest.raises(Exception, match="isn't below the folder"):
        sinks.put_files(bad, root, "k")
    assert found(root) == {} and not os.path.exists(tmp_path / "out.md")
    with pytest.raises(Exception, match="isn't below the folder"):
        sinks.put_files(spark.createDataFrame([("/etc/x", "x", "k")], KIND), root, "k")


def test_moves_can_be_run_again(tmp_path):
    """A task that is lost after its renames is run again: what it moved is in its place."""
    import pandas as pd

    (tmp_path / "s").write_text("x")
    b = pd.DataFrame({"path": ["d/f"], "staged": [str(tmp_path / "s")]})
    move = sinks._move(str(tmp_path))
    assert [list(move([b]))[0]["n"][0] for _ in range(2)] == [1, 1] and (tmp_path / "d" / "f").read_text() == "x"
    with pytest.raises(FileNotFoundError):
        list(move([b.assign(path="d/other")]))


def document(path):
    return "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in sorted(os.listdir(path)) if f.startswith("part-"))


def test_exports(spark, tmp_path):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = chunks(spark, *[{"id": f"i{i:02}", "content": f"line\n\"{i}\" é", "timestamp": f"2024-01-{i % 9 + 1:02}T00", "project": "p" if i % 3 else "q"} for i in range(50)], {"id": "n", "timestamp": None, "content": None}).repartition(3)
        out = str(tmp_path / "json")
        sinks.export_json(rows, out)
        got = json.loads(document(out))
        want = sorted(rows.collect(), key=lambda r: (r.timestamp or "", r.id))
        assert [(x["id"], x["content"], x["metadata"]["timestamp"], x["metadata"]["project"]) for x in got] == [(r.id, r.content, r.timestamp, r.project) for r in want]
        assert len([f for f in os.listdir(out) if f.startswith("part-")]) > 1
        sinks.export_json(rows, out, project="q")
        assert {x["metadata"]["project"] for x in json.loads(document(out))} == {"q"}
        sinks.export_json(rows, out, project="none")
        assert json.loads(document(out)) == []
        sinks.export_json(rows.where("id = 'i01'"), out)
        assert [x["id"] for x in json.loads(document(out))] == ["i01"]
        sinks.export_markdown(rows.where("project = 'q' AND id IS NOT NULL"), str(tmp_path / "md"))
        text = document(str(tmp_path / "md"))
        assert text.startswith("# Memory Export\n\nTotal chunks: 17\n") and text.count("\n---\n") == 17 and "## q — 2024-01-01\n*Source: " in text
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
