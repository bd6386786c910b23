import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lorekiln.llm import line_dedup, shared

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    rank = lambda i: shared.NULL_ID if i is None else i
    key = lambda line: low(line.strip(WHITE))
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(docs.get(key(x), ())) >= min_docs and max(docs[key(x)]) != rank(i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **more):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    out = line_dedup.deduped(df)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()), key=str), out.columns


@pytest.fixture
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_against_brute_force_with_hot_lines_over_many_partitions(spark, many_partitions):
    rnd = random.Random(5)
    pool = [f"line number {k} that is long enough to have a key of its own é" for k in range(30)]
    rows = []
    for i in range(400):
        lines = [rnd.choice(pool[:6] if rnd.random() < 0.5 else pool) for _ in range(rnd.randint(0, 6))]
        lines += [f"own line {i} {rnd.random()} which no other document has"] * rnd.randint(0, 2) + ["short"] * rnd.randint(0, 3)
        if rnd.random() < 0.7:
            lines.append("  The Very Common LINE that nearly every document has in it\t")
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    out, _ = got(spark, rows)
    assert out == brute(rows)
    assert sum(r[2] for r in out) > 300


def test_odd_rows(spark):
    line = "x" * 39 + "É"
    rows = [(None, line), (1, line), (1, line), (1, "other\n" + line.lower()), (2, line), (3, " " + line), (4, line + "\n" + line), (5, None), (6, ""), (7, "a\n\n"), (8, "\n".join(["é" * 39] * 3))]
    out, columns = got(spark, rows, _i=3, hi="clash", keep=1, n_lines="old")
    assert out == brute(rows)
    assert columns == ["doc_id", "text", "_i", "hi", "keep", "n_lines", "n_dropped"]
    assert got(spark, [])[0] == []


def test_a_stream_decides_alike_however_it_is_cut():
    rnd = np.random.default_rng(3)
    rows = sorted({(int(rnd.integers(6)), 0, -int(rnd.integers(12)), 0, int(rnd.integers(3))) for _ in range(120)})
    want = {r for r in rows if len({x[2] for x in rows if x[0] == r[0]}) >= 5 and r[2] != min(x[2] for x in rows if x[0] == r[0])}
    for _ in range(60):
        cuts = sorted({0, len(rows), *map(int, rnd.integers(0, len(rows), 3))})
        cuts = [c for c in cuts if c in (0, len(rows)) or rows[c - 1][:3] != rows[c][:3]]  # an id's rows of a key stay together
        drop, opened, edges = set(), [], defaultdict(list)
        for a, b in zip(cuts, cuts[1:]):
            part, batches = rows[a:b], []
            while part:
                n = int(rnd.integers(1, 9))
                head, part = part[:n], part[n:]
                cols = list(zip(*head))
                batches.append(pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array([-x for x in cols[2]]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], ["hi", "lo", "i", "v", "p"]))
            for out in line_dedup._settle(iter(batches), 5):
                for r in out.to_pylist():
                    row = (r["hi"], 0, -r["i"], 0, r["p"])
                    if r["kind"] == line_dedup.DROP:
                        drop.add(row)
                    elif r["kind"] == line_dedup.OPEN:
                        opened.append(row)
                    else:
                        edges[r["hi"]].append((r["n"], r["i"]))
        assert all(len(v) <= len(cuts) for v in edges.values())
        drop |= {r for r in opened if sum(n for n, _ in edges[r[0]]) >= 5 and -r[2] != max(i for _, i in edges[r[0]])}
        assert drop == want


def test_bitmaps_are_compressed_and_exact():
    gone = np.array([0, 9, 1000])
    packed = line_dedup.pack_bitmap(gone)
    assert len(packed) < 60
    assert np.flatnonzero(line_dedup.dropped_of(packed, 1001)).tolist() == gone.tolist()
    assert not line_dedup.dropped_of(None, 3).any()
