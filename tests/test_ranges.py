"""Chunks of sessions that are many ranges: equal to those of sessions that are gathered."""

import numpy as np
import pytest

from lorekiln.operators import ingest, ranges


def greedy(tokens, held, most):
    """Turn after turn: which begin a chunk, and what is held in the end."""
    begins = []
    for i, t in enumerate(tokens):
        if held == ranges.FRESH or held + t > most:
            begins.append(i)
            held = t
        else:
            held += t
    return begins, min(held, most + 1)


def test_tables_of_a_range():
    """From whatever a range begins with, the table says what turn after turn gives."""
    rng = np.random.default_rng(3)
    for most in (1, 7, 40):
        for size in (1, 2, 13, 90):
            tokens = rng.choice([0, 1, 2, 5, 9, 60], size)
            left, begun = ranges._table(tokens, most)
            for held in range(most + 2):
                starts, end = greedy(tokens, held, most)
                assert ranges._cut(tokens, held, most) == starts
                assert (int(left[held]), int(begun[held])) == (end, len(starts))
            assert ranges._cut(tokens, ranges.FRESH, most) == greedy(tokens, ranges.FRESH, most)[0]


@pytest.fixture
def many_ranges(spark):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[0])
    spark.conf.set("spark.sql.shuffle.partitions", kept[1])


KIND = "session_id string, source string, project string, git_branch string, started_at string, n bigint, role string, content string, timestamp string, tools array<string>"


def test_equals_gathered_sessions(spark, many_ranges):
    """One session of most turns, short ones, one turn above the limit, empty texts, absent times, equal numbers, and a session with an absent branch beside an empty one."""
    rng = np.random.default_rng(8)
    row = lambda s, n, text, t="t", role="human", branch="b": (s, "src", "p", branch, "start", n, role, text, t, [])
    rows = [row("long", i, "w" * int(rng.choice([0, 3, 200, 900, 5000])), "" if i % 11 == 0 else f"t{i:05}", "system" if i % 17 == 0 else "assistant") for i in range(900)]
    rows += [row(f"s{i}", j, "x" * 40 * j) for i in range(40) for j in range(i % 5)]
    rows += [row("same", 1, t) for t in ("b", "a", "a", "c" * 4000)] + [row("branch", 1, "one", branch=None), row("branch2", 1, "two", branch=""), row("only", 1, "z", role="system")]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    for most in (800, 60):
        want = sorted(map(tuple, ingest.chunks(df, most).collect()))
        got = sorted(map(tuple, ranges.chunks(df, most).collect()))
        assert got == want and len(want) > 100


def test_no_rows(spark):
    out = ranges.chunks(spark.createDataFrame([], KIND))
    assert out.collect() == [] and out.columns == ingest.chunks(spark.createDataFrame([], KIND)).columns
