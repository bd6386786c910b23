"""The log of injections as a ring: only the newest lines stay, whatever happens meanwhile."""

import os

import pytest

from lorekiln.operators import lifecycle


def log(spark, path, first, n):
    rows = [(f"t{i:05}", "p" * 20, "proj", "s", [f"c{i}"]) for i in range(first, first + n)]
    lifecycle.log_injections(spark.createDataFrame(rows, lifecycle.INJECTION).coalesce(2), path)


def times(spark, path):
    return sorted(r.timestamp for r in lifecycle.injections(spark, path).collect())


def test_prune_replaces_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert lifecycle.prune_injections(spark, path) == 0
    log(spark, path, 0, 30)
    with open(f"{path}/odd.json", "w") as f:
        f.write("{bad\n\n")
    assert lifecycle.prune_injections(spark, path, keep=10, least=1 << 20) == 0 and len(times(spark, path)) == 30
    assert lifecycle.prune_injections(spark, path, keep=10, least=100) == 21
    assert times(spark, path) == [f"t{i:05}" for i in range(20, 30)]
    log(spark, path, 30, 5)
    assert lifecycle.prune_injections(spark, path, keep=10, least=100) == 5
    assert times(spark, path) == [f"t{i:05}" for i in range(25, 35)]
    assert not [n for n in os.listdir(path) if "pruned-" in n or "mark-" in n]
    assert lifecycle.prune_injections(spark, path, keep=10, least=100) == 0


def test_lines_appended_meanwhile_stay_and_a_lost_prune_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log(spark, path, 0, 30)
    whole, calls = lifecycle._finish_prune, []

    def dies(spark, path):
        calls.append(1)
        if len(calls) == 2:  # the marker is down
            log(spark, path, 30, 3)
            raise OSError("lost")
        whole(spark, path)

    monkeypatch.setattr(lifecycle, "_finish_prune", dies)
    with pytest.raises(OSError, match="lost"):
        lifecycle.prune_injections(spark, path, keep=10, least=100)
    assert len(times(spark, path)) == 33  # nothing is gone yet
    monkeypatch.setattr(lifecycle, "_finish_prune", whole)
    assert lifecycle.prune_injections(spark, path, keep=50, least=1 << 30) == 0
    assert times(spark, path) == [f"t{i:05}" for i in range(20, 33)]


def test_a_prune_that_dies_before_its_marker_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log(spark, path, 0, 20)
    monkeypatch.setattr(lifecycle, "recent", lambda rows, *_: rows.where("assert_true(timestamp < 't00010') IS NULL"))
    with pytest.raises(Exception):
        lifecycle.prune_injections(spark, path, keep=10, least=100)
    assert len(times(spark, path)) == 20
