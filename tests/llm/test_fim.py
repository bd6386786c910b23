import hashlib
import random
import re

import pytest

from lorekiln.llm import fim
from lorekiln.llm import queries as Q

ODD = ["", None, "a", "ab", "é😀́x", "has <P> in it", "<S>", "x<M>", "<P", "P>", "<<P>>", "< P><S<M", "line\nline\n\n", "<" * 50 + ">" * 50, "q" * 5000]


def draws(doc_id, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def brute(doc_id, text, units=r"[\s\S]", percent=90):
    text, (h1, h2, h3, h4) = text or "", draws(doc_id)
    ends = [0, *(m.end() for m in re.finditer(units, text))]
    n = len(ends) - 1
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


KINDS = {
    "code points": (fim.CODE_POINTS, r"[\s\S]"),
    "words": (fim.WORDS, r"[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+"),
    "words and marks": (fim.WORDS_AND_MARKS, r"[ \t\n\x0b\x0c\r]+|[!-/:-@\[-`{-~]|[^ \t\n\x0b\x0c\r!-/:-@\[-`{-~]+"),
    "lines": (fim.Units(("\n",), frozenset({0})), r"\n|[^\n]+"),
}


@pytest.mark.parametrize("kind", KINDS)
def test_ranks_from_events_equal_a_regular_expression(kind):
    units, pattern = KINDS[kind]
    scanner, rnd = fim.Scanner(units, ("<P>", "<S>", "<M>")), random.Random(3)
    for _ in range(500):
        text = "".join(rnd.choice("ab é\n\t.,-<P>中 ") for _ in range(rnd.randint(0, 40)))
        changes, found = scanner.events(text)
        ranks = scanner.ranks(text, changes)
        ends = [0, *(m.end() for m in re.finditer(pattern, text))]
        assert (ranks.n, [ranks.end_of(k) for k in range(len(ends))]) == (len(ends) - 1, ends)
        assert [(p, k) for p, k in found] == [(m.start(), "PSM".index(m[1])) for m in re.finditer("<([PSM])>", text)]


def test_code_points_have_no_events_but_sentinels():
    scanner = fim.Scanner(fim.CODE_POINTS, ("<P>", "<S>", "<M>"))
    assert scanner.events("words and\nlines, é" * 100) == ([], [])


@pytest.mark.parametrize("kind", KINDS)
def test_against_brute_force(spark, kind):
    units, pattern = KINDS[kind]
    rnd = random.Random(4)
    rows = [(k, t, 7, "c") for k, t in enumerate(ODD)] + [(None, "null id", 1, None), (3, "again", 1, ""), (3, "again", 1, "")]
    rows += [(100 + k, "".join(rnd.choice("ab é\n<>PSM") for _ in range(rnd.randint(0, 60))), 1, "") for k in range(300)] + [(10**12, "long " * 2_000_000, 1, "")]
    made = fim.transformed(spark.createDataFrame(rows, "doc_id long, text string, n int, form string").repartition(3), units)
    back = fim.restored(made)
    got = sorted((tuple(r) for r in back.collect()), key=lambda r: (str(r[0]), r[5]))
    want = sorted(((*brute(i, t, pattern), t or "") for i, t, _, _ in rows), key=lambda r: (str(r[0]), r[5]))
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_sentinels_that_clash_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "x<P>", "<M>"), ("ab", "bc", "d"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.Scanner(fim.CODE_POINTS, bad)
    with pytest.raises(ValueError):
        fim.Scanner(fim.WORDS, (" ", "b", "c"))
    with pytest.raises(ValueError):
        fim.restore(fim.Scanner(fim.CODE_POINTS, ("<P>", "<S>", "<M>")), "<S>a<P>b<M>c", "psm")


def test_empty_table_and_query(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restored(fim.transformed(empty)).count() == 0
    rows = [(k, t) for k, t in enumerate(ODD)]
    spark.createDataFrame(rows, empty.schema).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = Q.op12_fim(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, out.collect())) == [(*brute(i, t)[:5], sha(brute(i, t)[5]), sha(t or "")) for i, t in rows]
