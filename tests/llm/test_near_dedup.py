import random
import re
from collections import defaultdict

import numpy as np

from lorekiln.llm import near_dedup, textnp
from lorekiln.llm.components import components


def brute(rows, size, num=80, den=100):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    near = defaultdict(set)
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and None not in (rows[x][0], rows[y][0]) and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                near[rows[x][0]].add(rows[y][0])
                near[rows[y][0]].add(rows[x][0])

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        return min(seen)

    out = [(i, len(s), None if i is None else least(i)) for (i, _), s in zip(rows, sets)]
    return sorted(((i, n, c, c == i) for i, n, c in out), key=str)


def got(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, key long")
    return sorted((tuple(r) for r in near_dedup.near_duplicates(df, size).collect()), key=str)


def wide(rows):
    return [(*r, "clash", 1) for r in rows]


def test_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    passage = [rnd.choice(vocab) for _ in range(40)]
    for g in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(1, 8)):
            words = list(base)
            for _ in range(rnd.randint(0, len(base) // 11)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append(words)
    rows += [passage + [rnd.choice(vocab) for _ in range(25)] for _ in range(30)]
    rnd.shuffle(rows)
    rows = [(i, " ".join(w).title() if i % 3 else " \n".join(w)) for i, w in enumerate(rows)]
    want = brute(rows, 2)
    assert sum(not r[3] for r in want) > 20
    assert got(spark, wide(rows), 2) == want


def test_odd_rows(spark):
    rows = [(None, "a b c"), (5, "a b c"), (4, "A b C "), (4, "x y"), (9, "x  y"), (7, None), (8, ""), (6, "  "), (3, "one"), (2, "ONE"), (1, "É"), (11, "é"), (12, "one"), (12, "one")]
    assert got(spark, wide(rows), 2) == brute(rows, 2)
    assert got(spark, [], 2) == []


def test_every_pair_within_the_radius_shares_a_key():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        x = rnd.integers(0, 65536, near_dedup.VALUES).astype(np.uint16)
        y = x.copy()
        at = rnd.choice(near_dedup.VALUES, near_dedup.RADIUS, replace=False)
        y[at] ^= 1
        kx, ky = near_dedup.chunk_keys(np.stack([x, y]))
        assert set(kx.tolist()) & set(ky.tolist())


def test_blocks_of_one_key_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 700)
    monkeypatch.setattr(near_dedup, "HUBS", 1)
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(i, base + "".join(f" x{i}y{j}" for j in range(3 + i % 5))) for i in range(20)]
    assert got(spark, wide(rows), 2) == brute(rows, 2)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(200, 230)] + [(7, 7), (None, 3), (301, 300), (300, 301)]
    out = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, **{k: 100 for k in range(200, 230)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_brief_sets_never_have_less_in_common():
    rnd = np.random.default_rng(2)
    pool = rnd.integers(0, 2**63, 6000, dtype=np.uint64)
    sets = [np.unique(rnd.choice(pool, n, replace=False)) for n in (5, 900, 2048, 2049, 2400, 2500, 3000)]
    brief = [x.astype(np.uint16 if len(x) <= near_dedup.BRIEF_16 else np.uint32) for x in sets]
    size, mark = np.array([len(x) for x in sets]), np.zeros(1 << 16, bool)
    for x in range(len(sets)):
        others = np.array([o for o in range(len(sets)) if o != x])
        for some in (others, others[size[others] <= near_dedup.BRIEF_16]):
            if len(some):
                got = near_dedup._meetings(size, brief, x, some, mark)
                assert (got >= [len(np.intersect1d(sets[x], sets[o])) for o in some]).all()
                assert not mark.any()


def test_crafted_words_are_told_apart(spark):
    """Thue-Morse words, which collide under any polynomial hash modulo 2**64."""
    x = "ab"
    while len(x) < 1024:
        x += x.translate(str.maketrans("ab", "ba"))
    rows = [(1, x), (2, x.translate(str.maketrans("ab", "ba"))), (3, x.upper())]
    assert got(spark, wide(rows), 2) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]


def test_blocks_do_not_change_sets(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["a", "b", "c" * 50, "d", "e"]) for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 300)] + ["x" * 300, "x" * 90 + " " + "y" * 90]
    raw = [t.encode() for t in texts]
    slices = [(b"".join(raw), np.cumsum([0, *map(len, raw)])), *((r, np.array([0, len(r)])) for r in raw)]
    whole = [near_dedup.shingle_sets(np.frombuffer(d, np.uint8), o, 5) for d, o in slices]
    small = textnp.blocks
    monkeypatch.setattr(textnp, "blocks", lambda d, o: small(d, o, 64))
    for (d, o), want in zip(slices, whole):
        assert all((x == y).all() for x, y in zip(near_dedup.shingle_sets(np.frombuffer(d, np.uint8), o, 5), want, strict=True))
    assert all((x == y[0]).all() for x, y in zip(whole[0], whole[1:], strict=True))
