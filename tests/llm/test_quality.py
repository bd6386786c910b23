import random
import re
import tracemalloc
from collections import Counter
from hashlib import blake2b

import numpy as np

from lorekiln.llm import quality, textnp

MASK = 2**64 - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def word_hash(word):
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")


def grams(text):
    words = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pairs = [mixed((a * int(textnp._LAG[0]) + b * int(textnp._LAG[1]) + 2) & MASK) for a, b in zip(words, words[1:])]
    return [g % quality.BUCKETS for g in words + pairs]


def surface(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [line for line in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again)


def fixture():
    rnd = random.Random(6)
    good = [f"word{k}" for k in range(60)]
    bad = [f"junk{k}|" for k in range(60)]
    rows, labels = [], []
    for i in range(160):
        junk = i % 4 == 0
        text = " ".join(rnd.choice(bad if junk else good) for _ in range(rnd.randint(5, 80)))
        rows.append((i, text.replace(" ", "\n") if i % 5 == 0 else text, "k", 1))
        if i % 2:
            labels.append((i, int(not junk), i % 9 == 0))
    rows += [(None, None, "k", 1), (900, "", "k", 1), (901, " \n\t", "k", 1), (902, "a b c d e f g h " * 9, "k", 1), (903, "same line é\nsame line é\n same line é\n\n", "k", 1), (5, rows[5][1], "k", 1), (904, "x" * 200_000 + " y", "k", 1)]
    labels = [(i, q, int(t)) for i, q, t in labels] + [(None, 1, 0), (5, None, None)]
    return rows, labels


def test_against_brute_force(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int").repartition(5)
    out = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns[:2] == ["doc_id", "text"] and len(out.columns) == len(set(out.columns))
    trusted = {i for i, q, t in labels if q == 1 and not t and i is not None}
    raw, target = Counter(), Counter()
    for t in {t for _, t, *_ in rows}:  # a text counts once, however many copies it has
        raw.update(grams(t))
        if any(i in trusted for i, x, *_ in rows if x == t):
            target.update(grams(t))
    share = sum(target.values()) / sum(raw.values())

    def ratio(b):
        return np.log((target[b] + quality.SMOOTHING) / (raw[b] * share + quality.SMOOTHING))

    seen = Counter()
    for r in out.collect():
        assert (r.word_chars is not None) and tuple(r)[2:7] == surface(r.text)
        g = grams(r.text)
        score = sum(map(ratio, g)) / max(len(g), 1)
        assert abs(r.score - score) < 1e-6
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and r.score >= quality.THRESHOLD)
        seen[r.base_failed, r.kept] += 1
    assert sum(seen.values()) == len(rows) and len(seen) == 3


def test_junk_goes_and_clean_documents_stay(spark):
    rows, labels = fixture()
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, k string, j int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in out.where("NOT base_failed AND doc_id < 160").collect():
        assert r.kept == (r.doc_id % 4 != 0)


def test_clean_documents_outside_a_small_trusted_set_stay(spark):
    """Rare words of a document that isn't trusted aren't held against it."""
    rnd = random.Random(8)
    words = [f"word{k}" for k in range(900)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(80))) for i in range(120)]
    labels = [(i, 1, 0) for i in range(0, 120, 4)]
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.where("NOT kept").count() == 0


def test_no_labels_and_no_rows(spark):
    rows, labels = fixture()
    kinds = "doc_id long, text string, k string, j int", "doc_id long, quality int, toxic int"
    out = quality.quality(spark.createDataFrame(rows, kinds[0]), spark.createDataFrame([], kinds[1]))
    assert out.where("kept = base_failed").count() == 0
    assert quality.quality(spark.createDataFrame([], kinds[0]), spark.createDataFrame(labels, kinds[1])).count() == 0


def test_trusted_rows_are_bounded_and_the_same_each_time(spark):
    labels = spark.createDataFrame([(i % 50, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    assert quality.trusted_ids(labels, 10) == quality.trusted_ids(labels.repartition(7), 10)
    assert len(set(quality.trusted_ids(labels, 10))) == 10


def test_words_do_not_depend_on_where_they_stand():
    texts = [b"ab cd", b"cd", b"", b"xab cd ab"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    word, doc = textnp.words(data, offsets)
    assert doc.tolist() == [0, 0, 1, 3, 3, 3]
    assert word.tolist() == [word_hash(w) for w in ("ab", "cd", "cd", "xab", "cd", "ab")]


def thue_morse(n):
    """Two strings whose polynomial hashes modulo 2**64 are equal, whatever the base."""
    x = "ab"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_lines_and_words_of_crafted_texts_are_told_apart():
    x, y = thue_morse(1024)
    text = f"{x}\n{y}\n{x} {y}\n{'z' * 100}\n{'z' * 100}\n {'z' * 100}".encode()
    got = quality.measure(np.frombuffer(text, np.uint8), np.array([0, len(text)]), None, quality.BUCKETS)
    assert got["n_dup_lines"].tolist() == [1] and got["n_words"].tolist() == [7]
    word, _ = textnp.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(set(word.tolist())) == 3


def test_blocks_do_not_change_what_is_measured(monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["one", "two", "three", "x" * 70, "é\n"]) for _ in range(rnd.choice([0, 1, 5, 300]))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    ratio = np.random.default_rng(1).normal(size=quality.BUCKETS)
    whole = quality.measure(data, offsets, ratio, quality.BUCKETS)
    for r in range(len(texts)):
        assert tuple(int(whole[c][r]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == surface(texts[r])
    small = textnp.blocks
    monkeypatch.setattr(textnp, "blocks", lambda d, o: small(d, o, 64))
    cut = quality.measure(data, offsets, ratio, quality.BUCKETS)
    for c in whole:
        assert np.allclose(whole[c], cut[c]), c


def test_a_very_long_text_takes_some_bytes_a_byte():
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    text = " ".join(rnd.choice(words) for _ in range(2_000_000)).encode()
    data = np.frombuffer(text, np.uint8)
    tracemalloc.start()
    got = quality.measure(data, np.array([0, len(text)]), np.zeros(quality.BUCKETS), quality.BUCKETS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["n_words"].tolist() == [2_000_000] and peak < 10 * len(text)


def test_a_clean_text_with_many_copies_and_no_label_stays(spark):
    rnd = random.Random(9)
    words, own = [f"word{k}" for k in range(900)], [f"other{k}" for k in range(200)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(80))) for i in range(300)]
    copied = " ".join(own)
    rows += [(1000 + i, copied) for i in range(150)]
    labels = [(i, 1, 0) for i in range(0, 300, 3)]
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.where("doc_id >= 1000 AND NOT kept").count() == 0 and out.count() == 450
