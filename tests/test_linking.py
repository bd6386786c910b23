"""Links of word sets: what many sets share is met in blocks, and no side of a join that grows with the sets is broadcast."""

import random

from lorekiln.operators import linking


def _sets(seed, n, common=("error", "pipe", "reader"), rare=6):
    rnd = random.Random(seed)
    return sorted({tuple(sorted({*common, *rnd.choices([f"w{k}" for k in range(40)], k=rnd.randint(0, rare))})) for _ in range(n)})


def _alike(a, b, threshold):
    return len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold


def test_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 5)
    sets = _sets(1, 60) + _sets(2, 30, ("push", "main", "branch", "never"))
    named = {" ".join(x): x for x in sets}
    df = spark.createDataFrame([(k, list(x)) for k, x in named.items()], "fingerprint string, tokens array<string>")
    root = {k: k for k in named}
    links = [(a, b) for a in named for b in named if a < b and _alike(named[a], named[b], 0.5)]
    for _ in named:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for pair in links for x in pair}
    assert {(r.node, r.root) for r in linking.clusters(df, 0.5).collect()} == {(k, root[k]) for k in linked}
    found = linking.links(df, 0.5)
    assert sorted(tuple(r) for r in found.collect()) == sorted(links)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joined = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join " in x]
    assert all("SortMergeJoin" in x or "LeftOuter" in x for x in joined) and any("SortMergeJoin" in x for x in joined)  # what is broadcast are the counts of blocks
