import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lorekiln.llm import prefix_trie
from lorekiln.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    whole = {c: [*own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)], *x[h:]] for c, x in own.items()}
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children[p]]
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + saved)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), *sums[p], sha([c for c in m if len(whole[c]) == len(p)])) for p, m in members.items())


def made(spark, rows, schema=SCHEMA):
    out = prefix_trie.trie(spark.createDataFrame(rows, schema).repartition(4))
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for c in range(120):
        same = rnd.random() < 0.4
        for t in range(rnd.choice([1, 2, 3, 5, 8, 13])):
            rows.append((c * rnd.choice([1, 1, 1, 3]) if not same else c, t, rnd.choice(["user", "assistant"]) if not same else "user", rnd.choice(["a", "bé", "ccc"]) if not same else f"t{t}"))
    rnd.shuffle(rows)
    assert made(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None, None, None), (5, None, "user", "n"), (5, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "user", "y"), (None, 1, "user", "lost"), (7, 3, "", ""), (7, 4, None, "z"), (8, 1, "use", "rx"), (9, 1, "user", "x"), (15, 0, "a", "b")]
    assert made(spark, rows) == brute(rows)
    assert made(spark, [r for r in rows if r[0] is None]) == []
    assert made(spark, []) == []
    clash = [(*r, 1, "x", 2) for r in rows]
    assert made(spark, clash, SCHEMA + ", node int, c string, depth long") == brute(rows)


def test_turnless_conversations_stay_in_the_root(spark):
    # none of these has a base, and each has fewer turns than the h that its id draws
    ids = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:7]
    rows = [(c, 0, "user", "gone") for c in ids]
    ((*node, sha),) = made(spark, rows)
    assert node == [ids[0], 0, None, 7, 0, 1, 0] and sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("piece", [1, 3, 1 << 15])
def test_one_conversation_many_times_and_a_long_one(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = [(c, t, "user", f"turn {t}") for c in range(0, 200) for t in range(9)] + [(1000, t, "user", f"turn {t}") for t in range(70)]
        assert made(spark, rows) == brute(rows)
    finally:
        spark.conf.set(name, old)


def test_code_and_sql(spark, tmp_path):
    import duckdb

    rnd = random.Random(6)
    rows = [(rnd.randrange(40), rnd.choice([None, 0, 1, 2, 3]), rnd.choice([None, "user"]), rnd.choice([None, "a", "é"])) for _ in range(150)] + [(None, 1, "user", "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({Q.ORACLES['op13_prefix_trie']})").fetchall()
    assert sorted(got) == sorted(map(tuple, Q.op13_prefix_trie(spark, str(tmp_path)).collect())) == brute(rows)
