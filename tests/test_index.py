"""The segmented index: after any sequence of changes a search equals one over the surviving rows."""

import random
import shutil
import threading

import pyarrow as pa
import pytest

from lorekiln.operators import index, search

KIND = "id string, session_id string, project string, source string, git_branch string, content string"
WORDS = "the and of parser cache redis pool é worker null config".split()


def _rows(seed, n, start=0):
    rnd = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    return [(f"k{start + k:03}", f"s{k % 7}", rnd.choice("abc"), rnd.choice("xy"), rnd.choice(["main", ""]), " ".join(rnd.choices(WORDS, weights, k=rnd.choice([0, 1, 5, 30, 60])))) for k in range(n)]


def _found(spark, rows, path, query, k=7, **filters):
    got = [(round(r.bm25, 9), r.id) for r in index.keyword(spark, path, query, k, **filters).collect()]
    df = spark.createDataFrame(rows, KIND)
    want = [(round(r.bm25, 9), r.id) for r in search.keyword(df, query, k, **filters).collect()] if rows else []
    assert got == want, (query, filters)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_any_sequence_of_changes(spark, tmp_path, seed):
    rnd, path, alive = random.Random(seed), str(tmp_path / "index"), {}
    start = _rows(seed, 40)
    assert index.write(spark.createDataFrame(start, KIND), path) == 40
    alive = {r[0]: r for r in start}
    for step in range(7):
        kind = rnd.choice(["append", "append", "project", "session", "ids", "merge"]) if step else "append"
        if kind == "append":
            new = _rows(seed * 100 + step, 25, rnd.randint(0, 60))
            fresh = [r for r in new if r[0] not in alive]
            assert index.append(spark.createDataFrame(new + new[:3], KIND), path) == len(fresh)
            alive |= {r[0]: r for r in fresh}
        elif kind == "merge":
            index.merge(spark, path, fan=2)
        else:
            p, s = rnd.choice("abc"), f"s{rnd.randint(0, 6)}"
            ids = rnd.sample(sorted(alive), min(5, len(alive)))
            gone = {i for i, r in alive.items() if (kind == "ids" and i in ids) or (kind == "session" and r[1] == s) or (kind == "project" and r[2] == p and r[3] == "x")}
            ask = {"ids": {"ids": [*ids, "none"]}, "session": {"session_id": s}, "project": {"project": p, "source": "x"}}[kind]
            assert index.delete(spark, path, **ask) == len(gone)
            alive = {i: r for i, r in alive.items() if i not in gone}
        n, mean = index.figures(spark, path)
        assert n == len(alive) and mean == pytest.approx(sum(len(r[5].split()) for r in alive.values()) / len(alive))
    rows = list(alive.values())
    assert {r.id for r in index.rows(spark, path).collect()} == set(alive)
    for q in ("the", "and of", "the-and", "redis the", "nowhere", "", "é"):
        _found(spark, rows, path, q)
    _found(spark, rows, path, "the and", project="a")
    _found(spark, rows, path, "the", source="y", git_branch="main")
    index.sweep(spark, path)
    _found(spark, rows, path, "the and")
    assert index.delete(spark, path) == 0 and index.delete(spark, path, everything=True) == len(rows)
    assert index.figures(spark, path) == (0, 0.0) and index.keyword(spark, path, "the").count() == 0


def test_levels_leave_postings_unread(spark, tmp_path):
    rows, path = _rows(5, 300), str(tmp_path / "index")
    index.write(spark.createDataFrame(rows[:200], KIND), path)
    index.append(spark.createDataFrame(rows, KIND), path)
    skipped = 0
    for q in WORDS:
        for k in (1, 5):
            _found(spark, rows, path, q, k)
            told = index.reading(spark, path, q, k)
            assert told["read"] + told["skipped"] == sum(q in r[5].split() for r in rows)
            skipped += told["skipped"]
    assert skipped > 500
    plan = index.keyword(spark, path, "the", 5)._jdf.queryExecution().toString()
    assert "/rows" not in plan and "level" in plan


def test_two_writers_and_a_killed_one(spark, tmp_path):
    path, rows = str(tmp_path / "index"), _rows(6, 30)
    index.write(spark.createDataFrame(rows[:10], KIND), path)
    counts = []
    jobs = [threading.Thread(target=lambda part=part: counts.append(index.append(spark.createDataFrame(part, KIND), path))) for part in (rows[:20], rows[5:25])]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert sum(counts) == 15 and index.figures(spark, path)[0] == 25
    assert index.rows(spark, path).count() == index.rows(spark, path).select("id").distinct().count() == 25
    index._segment(spark.createDataFrame(rows, KIND), path)  # a job that dies before it commits
    _found(spark, rows[:25], path, "the and")
    assert index.sweep(spark, path) >= 1
    _found(spark, rows[:25], path, "the and")
    log = index.Log(spark, path)
    index.append(spark.createDataFrame(rows[25:], KIND), path)
    with pytest.raises(index.Conflict):
        log.commit(log.segments, log.dead)


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(None, "s", "a", "x", "", "the"), ("e", "s", "a", "x", "", None), ("f", None, None, None, None, "the the"), ("f", None, None, None, None, "and")]
    assert index.write(spark.createDataFrame(rows, KIND), path) == 2
    assert [r.id for r in index.keyword(spark, path, "and").collect()] == ["f"] and index.keyword(spark, path, "the").count() == 0
    assert index.write(spark.createDataFrame([], KIND), path) == 0 and index.keyword(spark, path, "the").count() == 0
    assert index.append(spark.createDataFrame([("g", "the")], "id string, content string"), path) == 1
    assert [r.id for r in index.keyword(spark, path, "the").collect()] == ["g"] and index.keyword(spark, path, "the", project="a").count() == 0


def test_texts_stay_and_constants_are_not_shuffled(spark, tmp_path, monkeypatch):
    seen, write = [], index._write_postings
    monkeypatch.setattr(index, "_write_postings", lambda found, *more: seen.append(found.columns) or write(found, *more))
    path, rows = str(tmp_path / "index"), _rows(8, 40)
    df = spark.createDataFrame(rows, KIND)
    assert "Window" not in index._first(df)._jdf.queryExecution().optimizedPlan().toString()
    index.write(df.where("id < 'k020'"), path)
    assert index.append(df, path) == 20 and index.append(df, path) == 0 and index.merge(spark, path, everything=True) == 2
    assert len(seen) == 3 and not any({"segment", "tf"} & set(x) for x in seen)
    _found(spark, rows, path, "the and", project="a")


def test_runs_hold_all_postings_in_order(monkeypatch):
    monkeypatch.setattr(index, "RUN", 100)
    rows = [(r[0], r[2], r[3], r[4], len(r[5].split()), r[5]) for r in _rows(9, 60)] + [("long", "a", "x", "", 500, " ".join(WORDS[k * k % 11] for k in range(500)))]
    random.Random(9).shuffle(rows)
    names = ["id", *index.FILTERS, "dl", "words"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "dl" else pa.string()) for n, c in zip(names, zip(*rows[a : a + 13]))], names) for a in range(0, len(rows), 13)]
    got = [r for b in index._runs(iter(batches), 20.0) for r in b.to_pylist()]
    want = {(w, r[0]): [k for k, x in enumerate(r[5].split()) if x == w] for r in rows for w in set(r[5].split())}
    assert len(got) == len(want) and {(p["term"], p["id"]): p["positions"] for p in got} == want
    told = {r[0]: r for r in rows}
    for p in got:
        assert (p["id"], p["project"], p["source"], p["git_branch"], p["dl"]) == told[p["id"]][:5] and p["tf"] == len(p["positions"])
        assert p["level"] == int(index.LEVELS * p["tf"] / (p["tf"] + search.K1 * (1 - search.B + search.B * p["dl"] / 20)))
    keys = [(p["term"], -p["level"], p["id"]) for p in got]
    ends = sum(a > b for a, b in zip(keys, keys[1:]))
    assert 3 < ends < sum(r[4] for r in rows) / 100  # runs of 100 words and the row that fills them
    assert list(index._runs(iter([batches[0].slice(0, 0)]), 20.0)) == []


def test_postings_are_neither_shuffled_nor_read_by_a_merge(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "index"), _rows(10, 60)
    df = spark.createDataFrame(rows, KIND).repartition(9)
    written, write = [], index._write_postings
    monkeypatch.setattr(index, "_write_postings", lambda found, *more: written.append(found) or write(found, *more))
    index.write(df.where("id < 'k040'"), path)
    index.append(df, path)
    assert index.delete(spark, path, project="a") > 0
    for s in index.Log(spark, path).segments:
        shutil.rmtree(f"{path}/{s['name']}/postings")
    assert index.merge(spark, path, everything=True) == 2
    assert len(written) == 3 and not any("Exchange" in f.mapInArrow(index._runs, index.POSTINGS)._jdf.queryExecution().executedPlan().toString() for f in written)
    left = [r for r in rows if r[2] != "a"]
    for q in ("the", "and of", "the-and", "redis the"):
        _found(spark, left, path, q)
    _found(spark, left, path, "the and", source="y", git_branch="main")
