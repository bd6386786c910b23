"""Stores that are rewritten: archiving, deletes, and jobs that die between renames."""

import os

import pytest

from lorekiln.operators import ingest, lifecycle, mining

from .test_operators import chunks


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = chunks(
        spark,
        {"id": "a0", "session_id": "a", "project": "007", "content": "parser parser start", "timestamp": "2023-01-01T10"}, {"id": "a1", "session_id": "a", "project": "007", "content": "the end", "timestamp": "2023-01-02T10"},
        {"id": "b0", "session_id": "b", "project": None, "content": "old too", "timestamp": "2023-03-01"}, {"id": "c0", "session_id": "c", "content": "new", "timestamp": "2024-05-01"}, {"id": "d-archived", "session_id": "d", "timestamp": "2020-01-01"},
        {"id": "n0", "session_id": "", "content": "of no session", "timestamp": "2020-01-01"}, {"id": "n1", "session_id": None, "content": "of none", "timestamp": "2020-01-01"}, {"id": "e0", "session_id": "e", "timestamp": ""},
    )
    assert ingest.append(rows, path) == 8
    return path, rows.schema


def ids(spark, store):
    return sorted(r.id for r in ingest.stored(spark, *store).collect())


def test_archive_counts_writes_and_rests(spark, store):
    path, schema = store
    want = {"sessions_considered": 5, "sessions_archived": 2, "sessions_already_archived": 1, "chunks_removed": 3, "chunks_added": 2, "bytes_before": 33}
    before = ids(spark, store)
    tried = lifecycle.archive(spark, path, schema, "2024-01-01", dry_run=True)
    assert {k: tried[k] for k in want} == want and ids(spark, store) == before
    done = lifecycle.archive(spark, path, schema, "2024-01-01")
    assert done == tried
    assert ids(spark, store) == ["a-archived", "b-archived", "c0", "d-archived", "e0", "n0", "n1"]
    rows = {r.id: r for r in ingest.stored(spark, path, schema).collect()}
    assert done["bytes_after"] == len(rows["a-archived"].content) + len(rows["b-archived"].content) and (rows["a-archived"].project, rows["b-archived"].project) == ("007", None)
    again = lifecycle.archive(spark, path, schema, "2024-01-01")
    assert (again["sessions_archived"], again["sessions_already_archived"], again["chunks_removed"]) == (0, 3, 0)
    assert [x for x in os.listdir(os.path.dirname(path)) if x.startswith("store.")] == []


def test_archive_of_one_project(spark, store):
    path, schema = store
    assert lifecycle.archive(spark, path, schema, "2024-01-01", project="007")["sessions_archived"] == 1
    assert ids(spark, store) == ["a-archived", "b0", "c0", "d-archived", "e0", "n0", "n1"]


def test_deletes_count_and_write(spark, store):
    path, schema = store
    assert lifecycle.delete(spark, path, schema, session="a") == 2
    assert lifecycle.delete(spark, path, schema, session="a") == 0
    assert lifecycle.delete(spark, path, schema, project="p") == 5
    assert ids(spark, store) == ["b0"]
    assert lifecycle.delete(spark, path, schema, everything=True) == 1 and ids(spark, store) == []
    assert lifecycle.archive(spark, str(path) + "-none", schema, "2024-01-01")["sessions_considered"] == 0


def test_a_rewrite_that_dies_between_its_renames_is_undone(spark, store):
    path, schema = store
    before = ids(spark, store)
    os.rename(path, path + ".old-x")
    assert ids(spark, store) == before and os.path.isdir(path)
    with pytest.raises(Exception):
        ingest.rewrite(ingest.stored(spark, path, schema).selectExpr("*", "assert_true(id < 'b') AS x"), path)
    assert ids(spark, store) == before


def test_columns_are_those_of_the_schema(spark, store):
    assert ingest.stored(spark, *store).columns == store[1].names


def test_least_sessions():
    assert [mining.least_sessions(x) for x in (0, 3, "7", 99, None, "x")] == [2, 3, 7, 20, 3, 3]
