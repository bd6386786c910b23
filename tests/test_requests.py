"""Requests for a file's context: who is answered, in batch, in a stream, and after a batch that failed."""

import os
from datetime import datetime, timedelta

import pytest

from lorekiln.streaming import jobs, requests

KIND = "owner string, request long, path string, at timestamp, block string"
START = datetime(2024, 1, 1)


def asked(paths=12, n=400):
    rows = [(f"o{k % 3}" if k % 11 else None, k, f"p{(k * 7) % paths}", START + timedelta(seconds=(k * 13) % 900 + k / 1000), None if k % 5 == 0 else f"b{k}") for k in range(n)]
    return rows + [("o1", n, "", START, "x"), ("o1", n + 1, None, START, "x"), ("o1", n + 2, "p1", None, "x")]


def plain(rows, seconds=60.0, most=200, forget=4.0):
    """The state as one table of times a caller keeps: looked up, and after an answer forgotten and cut."""
    told, out = {}, set()
    for owner, request, path, at, block in sorted((r for r in rows if r[3] is not None), key=lambda r: (str(r[0]), r[3], r[1])):
        mine = told.setdefault(owner, [])
        last = [t for p, t in mine if p == path]
        if not path or block is None or (last and (at - last[0]).total_seconds() < seconds):
            continue
        out.add(request)
        mine = [x for x in mine if x[0] != path] + [(path, at)]
        mine = [x for x in mine if (at - x[1]).total_seconds() < seconds * forget]
        told[owner] = sorted(mine, key=lambda x: x[1])[-most:]
    return out


@pytest.mark.parametrize("most", [200, 3])
def test_batch(spark, most):
    rows = asked()
    out = requests.answered(spark.createDataFrame(rows, KIND), most=most)
    got = out.collect()
    assert {r.request for r in got} == plain(rows, most=most) and out.columns == ["owner", "request", "path", "at", "block"]
    # the bound on the state tells here: with it more are answered
    assert len(plain(rows, most=3)) > len(plain(rows))
    assert requests.answered(spark.createDataFrame([], KIND)).collect() == []


def test_old_paths_are_forgotten():
    told = requests.Passed(60, 200, 4)
    assert told.answers("a", 0) and told.answers("b", 100 * 10**6) and told.answers("c", 239 * 10**6)
    assert set(told.told) == {"a", "b", "c"}
    assert told.answers("d", 240 * 10**6) and set(told.told) == {"b", "c", "d"}
    assert not told.answers("d", 299 * 10**6) and told.answers("d", 300 * 10**6)


def test_state_is_kept_only_for_what_was_delivered(spark, tmp_path):
    """The second batch fails in the sink; run again, it answers what it would have, from the state before it."""
    rows = sorted((r for r in asked(n=120) if r[3]), key=lambda r: r[3])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    broken = [False]

    def deliver(batch, number):
        if broken[0]:
            batch.collect()  # all work is done, and nothing delivered
            raise OSError("sink is away")
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    def run():
        stream = requests.answered_stream(jobs.new_files(spark, source, KIND))
        query = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)  # it ends by itself

    half = len(rows) // 2
    spark.createDataFrame(rows[:half], KIND).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame(rows[half:], KIND).coalesce(1).write.mode("append").parquet(source)
    broken[0] = True
    with pytest.raises(Exception, match="(?i)foreach.?batch|sink is away"):
        run()
    broken[0] = False
    run()
    got = [r.request for b in os.listdir(out) for r in spark.read.parquet(f"{out}/{b}").collect()]
    assert sorted(got) == sorted(plain(rows))
