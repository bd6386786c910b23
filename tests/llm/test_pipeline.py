"""The stages over a small corpus, each against what the one before it returned."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lorekiln.llm import mixing, packing, quality


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rnd = random.Random(12)
    good, bad = [f"word{k}" for k in range(900)], [f"|junk{k}|" for k in range(200)]
    say = lambda pool, n: " ".join(rnd.choice(pool) for _ in range(n))
    common = say(good, 15)
    rows = []
    for i in range(240):
        if i % 6 == 0:
            text = say(bad, 60)
        elif i % 6 == 1 and i > 20:
            words = rows[i - 12][1].split("\n")[0].split() if i % 12 == 1 or i % 24 == 19 else say(good, 90).split()
            if i % 24 == 19:  # a near copy; those of i % 12 == 1 are exact, and line dedup empties all but the last
                words[40] = "other"
            text = " ".join(words)
        else:
            text = say(good, rnd.randint(40, 120))
        if i % 7 == 2:
            text += "\n" + common
        rows.append((i, text, "en", f"src{i % 5}" if i % 3 else "src0", len(text)))
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    # labels cover all kinds of rows, the group of copies (i % 12 == 1) too
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240) if i // 2 % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out, now = [docs], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, path).write.parquet(f"{path}/{k}-{name}")
        now = spark.read.parquet(f"{path}/{k}-{name}")
        out.append(now)
    return path, out


def test_stages_return_the_columns_of_documents(stages):
    for df in stages[1][:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "best_fit_packing"]


def test_quality_drops_junk_alone(stages):
    before, after = stages[1][:2]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if r.doc_id % 6}
    assert quality.MIN_WORDS == 20


def test_lines_and_their_lengths(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[1][1:3])
    assert set(before) == set(after)
    lines = defaultdict(set)
    for r in before.values():
        for x in r.text.split("\n"):
            lines[x.strip(" \t\n\v\f\r").lower()].add(r.doc_id)
    gone = 0
    for i, r in after.items():
        want = [x for x in before[i].text.split("\n") if len(k := x.strip(" \t\n\v\f\r").lower()) < 40 or len(lines[k]) < 5 or max(lines[k]) == i]
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)
        gone += len(before[i].text) - len(r.text)
    assert gone > 0


def test_one_of_each_group_stays(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[1][2:4])
    five = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} or {tuple(t.split())} - {()}
    sets = {i: five(t) for i, t in before.items()}
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    groups = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and near(sets[a], sets[b]):
                x, y = groups[a], groups[b]
                groups = {k: min(x, y) if v in (x, y) else v for k, v in groups.items()}
    assert set(after) == set(groups.values()) and len(after) < len(before)
    assert any(not t for t in after.values())  # texts without words link with nothing


def test_the_mix_takes_effect(stages):
    before, after = stages[1][3:5]
    want = {r.i: r.copies for r in mixing.mix(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: c for i, c in want.items() if c})


def test_all_of_the_mix_is_packed(spark, stages):
    path, out = stages
    words = sum(len(r.text.split()) for r in out[4].collect())
    rows = out[5].collect()
    assert sum(r.length for r in rows) == words
    room, texts = Counter(), defaultdict(list)
    for r in rows:
        if r.bin is None:
            assert r.n_words == 0
            continue
        room[r.shard, r.bin] += r.length
        texts[r.shard, r.bin].append(r.doc_id)
    assert max(room.values()) <= packing.CAPACITY
    assert all(len(set(x)) == len(x) for x in texts.values())  # copies of a document never share a bin
    assert corpus_pipeline.run(spark, path).exceptAll(out[5]).count() == 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Repeated rows, null ids, texts, sources and lengths, an empty and a very long text, extra columns named like those of the stages."""
    clean, other = (" ".join(f"{w}{k}" for k in range(60)) for w in ("word", "term"))
    rows = [
        (1, clean, "en", "a", 9), (1, clean, "en", "a", 9), (2, other, None, None, 9), (3, None, "en", "a", None), (None, clean + " end", "en", "a", 9),
        (None, None, None, None, None), (4, "", "en", "b", 0), (5, "long " + "w" * 3_000_000 + " " + clean, "en", "b", 9),
    ]
    docs = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, words string, kept string, size int")
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_in_each_stage(spark, odd, k):
    path, docs = odd
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, docs.limit(0), path).count() == 0
    out = stage(spark, docs, path)
    found = Counter((r.doc_id, r.source) for r in out.collect())
    whole = {(1, "a"): 2, (2, None): 1, (3, "a"): 1, (None, "a"): 1, (None, None): 1, (4, "b"): 1, (5, "b"): 1}
    if k < 4:
        assert out.columns == list(corpus_pipeline.COLUMNS)
    if name == "quality_rules":
        assert found == {i: n for i, n in whole.items() if i not in {(3, "a"), (None, None), (4, "b")}}
    elif name == "near_dedup":
        assert found == {i: n for i, n in whole.items() if i != (5, "b")}  # near 1; rows without an id stay
    elif name == "mix_sources":
        want = Counter()
        for r in mixing.mix(docs.select(*corpus_pipeline.COLUMNS)).collect():
            want[r.i] += r.copies
        got = Counter(r.doc_id for r in out.collect())
        assert got == Counter({i: n for i, n in want.items() if n})
    else:
        assert found == whole
    if name == "line_dedup":
        texts = {(r.doc_id, r.source): (r.text, r.n_chars) for r in out.collect()}
        assert texts[3, "a"] == (None, 0) and texts[4, "b"] == ("", 0) and texts[5, "b"][1] == 3_000_415 and texts[1, "a"][1] == 409
    if name == "best_fit_packing":
        assert {r.doc_id for r in out.collect() if r.bin is None} == {3, 4, None}
        assert sum(r.length for r in out.collect()) == 60 * 3 + 61 + 62
