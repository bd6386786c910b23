import random
from collections import defaultdict

from lorekiln.llm import mixing


def fill(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    """Targets by going round until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, budget * sum(sizes.values()), set(order)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def rows_of(n=600):
    rnd = random.Random(4)
    return [(i, rnd.choice(["a", "a", "a", "B", "é", "z", None, "src10", "src2"]), "w " * rnd.randint(0, 60), 1) for i in range(n)]


def test_targets_and_taken_words(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, words long")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size
    want = fill(sizes)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_the_mix_repeats_rows_as_often_as_it_takes_them(spark):
    df = spark.createDataFrame(rows_of(), "doc_id long, source string, text string, words long").withColumnRenamed("words", "repeats")
    copies = {r.i: r.copies for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    assert dict(seen) == {i: c for i, c in copies.items() if c}
    assert max(copies.values()) == 2


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "a", None), (1, "a", ""), (2, "a", "x y"), (2, "a", "x y"), (3, "b", "  z")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sorted(r.size for r in out) == [0, 0, 0, 2, 2, 2]
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, "a", None), (2, "b", " ")], "doc_id long, source string, text string")).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0)] * 2


def test_many_sources_are_joined_and_not_sent(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(200), "doc_id long, source string, text string, words long")
    want = sorted(map(tuple, mixing.mix(df).collect()), key=str)
    monkeypatch.setattr(mixing, "SENT_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(df).collect()), key=str) == want
