"""To-dos and what resolves them, against all pairs; equal sets are held against each other once however many rows have them."""

import random

import pytest

from lorekiln.operators import linking, mining

KIND = "id string, session_id string, project string, source string, timestamp string, n int, text string, tokens array<string>"


def _rows(seed, n, tag):
    rnd = random.Random(seed)
    words = "parser cache update retry logic client reader docs".split()
    times = ["2024-01-02", "2024-01-02T10:00:00Z", "2024-01-02T11:00:00Z", "2024-01-05T09:00:00Z", "2024-02-01", "2024-02-01T23", "", None]
    return [(None if k == 7 else f"{tag}{k:03}", "s", rnd.choice(["p", "p", "q", None]), "x", rnd.choice(times), rnd.randint(0, 1), "t", sorted(rnd.sample(words, rnd.randint(1, 4)))) for k in range(n)]


@pytest.mark.parametrize("seed", [1])
def test_resolution_equals_all_pairs(spark, monkeypatch, seed):
    met = []
    across = linking.across
    monkeypatch.setattr(linking, "across", lambda left, right, *more: met.append((left.count(), right.count())) or across(left, right, *more))
    todos, done = _rows(seed, 120, "t"), _rows(seed + 50, 60, "d")
    out = mining.resolved_todos(spark.createDataFrame(todos, KIND), spark.createDataFrame(done, KIND)).collect()

    def best(t):
        some = [(d[4], d[0]) for d in done if None not in (d[0], d[2], d[4], t[0], t[4]) and d[2] == t[2] and d[4] > t[4] and len(set(d[7]) & set(t[7])) / len(set(d[7]) | set(t[7])) >= 0.4]
        return min(some, default=(None, None))

    want = sorted(((t[0] or "", t[5], t[4] or "", best(t)[0] is not None, best(t)[1] or "", best(t)[0] or "") for t in todos))
    assert sorted((r.id or "", r.n, r.timestamp or "", r.resolved, r.resolved_by or "", r.resolved_at or "") for r in out) == want
    assert sum(x[3] for x in want) > 20
    sets = lambda rows: len({(r[2], tuple(r[7])) for r in rows if None not in (r[0], r[2], r[4])})
    assert met == [(sets(todos), sets(done))] and sets(done) < 60
