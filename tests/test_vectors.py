import numpy as np
import pytest

from lorekiln.operators import vectors

KIND = "id string, project string, embedding array<float>"


def _rows(n=1500, dimension=24, seed=1):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(12, dimension))
    x = middle[rnd.integers(0, 12, n)] * 1.2 + rnd.normal(size=(n, dimension))
    x[: n // 3] = middle[0] + 0.2 * rnd.normal(size=(n // 3, dimension))  # one list may hold a third of all
    x[n - 5 :] = x[0]
    return [(f"v{k}", "ab"[k % 2], [float(y) for y in r]) for k, r in enumerate(x.astype(np.float32))]


def _exact(rows, vector, k):
    x = np.array([r[2] for r in rows])
    like = x @ vector / np.linalg.norm(x, axis=1) / np.linalg.norm(vector)
    return sorted(zip(np.round(1 - like, 9), (r[0] for r in rows)))[:k]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    odd = [("null", "a", None), ("zero", "a", [0.0] * 24), ("short", "a", [1.0]), ("empty", "a", []), ("nan", "a", [float("nan")] * 24), ("hole", "a", [None] + [1.0] * 23)]
    n = vectors.write(spark.createDataFrame(_rows() + odd, KIND), path)
    assert n == 39 and vectors.Index(spark, path).probes < 20  # lists: the root of the usable rows
    return path


def test_exact_search_equals_all_distances(spark, built):
    rows = _rows()
    for q in (0, 7, 800, 1499):
        for mine, which in (({}, rows), ({"project": "b"}, [r for r in rows if r[1] == "b"])):
            got = [(round(r.distance, 9), r.id) for r in vectors.nearest(spark, built, rows[q][2], 10, probes=2, exact=True, **mine).collect()]
            want = _exact(which, np.array(rows[q][2]), 10)
            assert [x for x, _ in got] == pytest.approx([x for x, _ in want], abs=1e-8) and {i for _, i in got} == {i for _, i in want}
    assert vectors.nearest(spark, built, [1.0], 10).count() == vectors.nearest(spark, built, [0.0] * 24, 10, exact=True).count() == 0
    assert vectors.nearest(spark, built, rows[0][2], 2000, exact=True).count() == 1500


def test_recall_and_pruning(spark, built):
    rows = _rows()
    asked = spark.createDataFrame(rows[::100], KIND)
    found = vectors.nearest_many(spark, built, asked, 10)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], {})[r.id] = r.distance
    hits = 0
    for i, _, v in rows[::100]:
        last = _exact(rows, np.array(v), 10)[-1][0]
        hits += sum(x <= last + 1e-9 for x in got[i].values())
    assert hits / (10 * len(got)) >= 0.9 and len(got) == 15 and all(len(x) == 10 for x in got.values())
    index = vectors.Index(spark, built)
    plan = index.rows([3, 5])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert {r.list for r in index.rows([3, 5]).select("list").distinct().collect()} <= {3, 5}


def test_codes_are_off_by_no_more_than_they_say(spark, built):
    rows = {i: np.array(v) / np.linalg.norm(v) for i, _, v in _rows()}
    index, unit = vectors.Index(spark, built), rows["v9"]
    for r in index.likened(list(range(len(index.centres))), unit).collect():
        assert abs(r.likeness - rows[r.id] @ unit) <= r.off + 1e-9


def test_append_and_empty(spark, tmp_path):
    rows, path = _rows(300), str(tmp_path / "x")
    vectors.write(spark.createDataFrame(rows[:200], KIND), path, lists=5)
    new = spark.createDataFrame(rows[150:], KIND)
    vectors.append(new, path)
    vectors.append(new, path)
    assert spark.read.parquet(f"{path}/vectors").count() == 300
    got = {r.id for r in vectors.nearest(spark, path, rows[250][2], 10, probes=1, exact=True).collect()}
    assert got == {i for _, i in _exact(rows, np.array(rows[250][2]), 10)}
    none = str(tmp_path / "none")
    assert vectors.write(spark.createDataFrame([], KIND), none) == 0
    vectors.append(spark.createDataFrame(rows, KIND), none)
    assert vectors.nearest(spark, none, [1.0], 3, exact=True).count() == vectors.nearest_many(spark, none, new, 3).count() == 0
