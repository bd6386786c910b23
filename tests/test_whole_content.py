"""Queries over whole documents: what stands far behind the first characters counts."""

import re

import pytest
from lorekiln.functions import patterns as P
from lorekiln.plans import views as V
from lorekiln.plans.queries import ORACLES, QUERIES

FILL = "Lorem 1, ipsum 2: dolor; sit amet.\n" * 20
TEXTS = [
    FILL + "Later the build 42 failed with error E77 in module alpha.\r\n\tTODO: rotate the signing keys, v2. Then rest.\nWe decided to keep port 8080 open. Next.",
    FILL + "implemented shard mover 3\n  never store raw tokens in logs! ok\nFIXME: unblock queue 9 drain\n",
    FILL * 9 + "worker pool 7 crashed: timeout after 30s always pin exact versions. \n\nthe plan is monthly cuts",
    "short",
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en", "src1") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return d


def whole(i):
    return V.CUES[i % len(V.CUES)] + (V.CUES[(i * 7 + 3) % len(V.CUES)] if i % 3 == 0 else "") + TEXTS[i]


def words(text, stop):
    return sorted({w.lower() for w in re.findall("[A-Za-z][A-Za-z0-9_]+", text)} - set(stop) - {w.lower() for w in re.findall("[A-Za-z][A-Za-z0-9_]+", text) if len(w) < 3})


def told(patterns, text):
    return any(re.search(p, text) for p in patterns)


def test_the_view_keeps_every_character(spark, small):
    assert {int(r.id): r.content for r in V.cued(spark, small).collect()} == {i: whole(i) for i in range(len(TEXTS))}


def test_lines_behind_the_first_characters_are_found(spark, small):
    problems, done = set(), set()
    for i in range(len(TEXTS)):
        for n, line in enumerate(whole(i).splitlines()):
            line = line.strip()
            if len(line) >= 8 and told(P.PROBLEMS, line[:240]) and len(words(line[:240], P.PROBLEM_STOPWORDS)) >= 3:
                problems.add((str(i), n, line[:240]))
            if len(line) >= 8 and re.search(P.DONE, line) and words(line, P.TODO_STOPWORDS):
                done.add((str(i), n, line))
    assert {tuple(r) for r in QUERIES["problem_lines"](spark, small).collect()} == problems
    assert {tuple(r) for r in QUERIES["done_signals"](spark, small).collect()} == done
    assert any(n >= 20 for _, n, _ in problems) and any(n >= 20 for _, n, _ in done)


def test_todos_rules_and_decisions_behind_the_first_characters_are_found(spark, small):
    todos = {r.text for r in QUERIES["todo_extract"](spark, small).collect()}
    assert {"rotate the signing keys, v2", "unblock queue 9 drain"} <= todos
    assert {"never store raw tokens in logs", "always pin exact versions"} <= {r.text for r in QUERIES["rule_extract"](spark, small).collect()}
    said = [r.text for r in QUERIES["decision_extract"](spark, small).collect()]
    assert any(x.endswith("We decided to keep port 8080 open.") for x in said) and any(x.endswith("the plan is monthly cuts") for x in said)


def test_no_sql_cuts_what_it_reads():
    """That queries and SQL agree over whole texts is `test_equals_sql` of the catalogue."""
    assert not [k for k, v in ORACLES.items() if re.search(r"substr\(content, 1, (60|90)\)", v)]


FENCES = "a\n\n\n\nb" * 20 + "\n[Tools used: Read]\n```sql\n" + "\n".join(f"row {k}" for k in range(9)) + "\n```\n**Assistant**: [Used tools: Bash]\nlast  \n\n\n"


def shortened(text):
    out, inside, n = [], False, 0
    for line in text.split("\n"):
        if line.strip().startswith("```"):
            out += ["  ... (truncated)"] * (inside and n > 4) + [line]
            inside, n = not inside, 0
        elif inside:
            n += 1
            out += [line] * (n <= 4)
        else:
            out.append(line)
    return "\n".join(out)


def test_fences_and_noise_behind_the_first_characters_are_met(spark, tmp_path):
    texts = [FENCES, "x" * 300 + "\n```\n1\n2\n3\n4\n5\n", "plain"]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    fenced = {str(i): "```py\n" + "\n".join(f"line {k}" for k in range(1, i % 5 + 3)) + "\n```\n" + t for i, t in enumerate(texts)}
    assert {r.id: r.text for r in QUERIES["truncate_code"](spark, str(tmp_path)).collect()} == {i: shortened(t) for i, t in fenced.items()}
    quiet = {i: "\n".join(x for x in t.split("\n") if not re.match(r"\[(?:Used )?[Tt]ools?(?: used)?:|\*\*Assistant\*\*: \[Used tools:", x.strip())) for i, t in fenced.items()}
    assert {r.id: r.text for r in QUERIES["optimize_content"](spark, str(tmp_path)).collect()} == {i: re.sub(r"\n{3,}", "\n\n", shortened(t + "\n \n")).strip() for i, t in quiet.items()}


def test_transcripts_keep_what_the_reference_keeps(spark, tmp_path):
    import hashlib

    turns = {1: 5, 2: 60, 3: 61}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t} " + "é" * 500) for c, n in turns.items() for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, n in turns.items():
        said = lambda t: f"### You\n{c}-{t} " if t % 2 == 0 else f"### Assistant{chr(10) + '> Tools: Read, Edit' if t % 3 == 1 else ''}\n{c}-{t} "  # noqa: E731, B023
        parts = [said(t) + "é" * 500 for t in range(n) if n <= 60 or t < 30 or t >= n - 30]
        if n > 60:
            parts.insert(30, f"*[{n - 60} exchanges omitted; full content in the store]*")
        want[f"c{c}"] = hashlib.md5("\n\n---\n\n".join(parts).encode()).hexdigest()
    assert {r.session_id: r.transcript for r in QUERIES["session_transcripts"](spark, str(tmp_path)).collect()} == want
