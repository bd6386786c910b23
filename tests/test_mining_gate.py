"""Literals that gate the mining expressions: nothing is lost, and groups and matches are those of the expressions alone."""

import random

import pytest
from pyspark.sql import functions as F

from lorekiln.functions import patterns as P
from lorekiln.functions import text as T
from lorekiln.operators import mining

#: A text that each expression matches, in their order.
SAID = {
    "PROBLEMS": ["Error", "exceptional", "TRACEBACK", "broken", "doesn’t  work", "not working", "isn't working", "failure", "crashing", "not  defined", "NULL", "stack  trace", "can’t", "cannot", "bug", "regression", "hangs", "timeout", "503"],
    "TODOS": ["TODO: a.", "FIXME\n\nb", "xxx c!", "we  should d", "I'll circle back to e.", "lets fix f.", "needs to g?", "would be GREAT to h.", "gonna fix i.", "add j  later"],
    "DONE": ["took\ncare of"],
    "RULES": ["please don’t a.", "do not b", "never c!", "always d", "stop using e.", "use f rather than g.", "prefer h over i", "avoid j", "I already told you not to k", "remember to l", "make sure that m"],
    "DECISIONS": ["deciding on", "we'll go with", "went with", "chose a over", "the plan is", "agreed on", "switching to", "let's go with", "will use", "recommended using", "picked a instead", "migrating from", "replacing a b with"],
}


def _of(name):
    found = getattr(P, name)
    return (found,) if isinstance(found, str) else found


@pytest.mark.parametrize("name", SAID)
def test_every_expression_has_its_literals(spark, name):
    literals = getattr(P, {"PROBLEMS": "PROBLEM", "TODOS": "TODO", "RULES": "RULE", "DECISIONS": "DECISION"}.get(name, name) + "_LITERALS")
    patterns = _of(name)
    assert len(patterns) == len(literals) == len(SAID[name])
    odd = str.maketrans("iIkKsS", "ıİ\u212a\u212aſſ")
    rows = [(k, t, p) for k, (t, p) in enumerate(zip(SAID[name], patterns))]
    rows += [(k, form(t), p) for k, t, p in rows for form in (str.upper, str.lower, lambda x: x.translate(odd))]
    df = spark.createDataFrame(rows, "k int, t string, p string")
    group = F.element_at(F.array(*[T.has_any(T.literals_in(F.col("t"), literals), g, literals) for g in literals]), F.col("k") + 1)
    out = df.select("k", "t", F.expr("t RLIKE concat('(?Ud)', p)").alias("hit"), T.may_match(F.col("t"), literals).alias("may"), group.alias("own")).collect()
    assert {r.k for r in out if r.hit} == set(range(len(patterns)))
    assert all(r.may and r.own for r in out if r.hit), [r for r in out if r.hit and not (r.may and r.own)]


def _texts():
    rnd = random.Random(8)
    words = [w for x in SAID.values() for t in x for w in t.split(" ")] + [".", "!", "\n", "\n\n", "  ", "to", "do", "instead", "not", "over", "later", "with", "x", "y", "é", " ", "\r\n"]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25))) for _ in range(400)] + ["", "come back todo later.", "going todo x.\n"]


@pytest.mark.parametrize("name", ["TODOS", "RULES"])
def test_captures_equal_the_expressions_alone(spark, name):
    patterns, literals = _of(name), getattr(P, name[:-1] + "_LITERALS")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(_texts())], "id int, content string")
    content = F.col("content")

    def plain(p):
        every = lambda g: F.regexp_extract_all(content, F.lit(P.PYTHON + p), F.lit(g))
        two = p.count("(") - p.count("(?") == 2
        body = F.zip_with(every(1), every(2), lambda a, b: F.concat_ws(" ", F.when(a != "", a), F.when(b != "", b))) if two else every(1)
        return F.zip_with(every(0), body, lambda m, b: F.struct(m.alias("m"), T.strip(b).alias("b")))

    has = T.literals_in(content, literals)
    got = F.array(*[mining._captures(content, p, T.has_any(has, g, literals)) for p, g in zip(patterns, literals)])
    rows = df.select("id", got.alias("got"), F.array(*map(plain, patterns)).alias("want")).collect()
    assert [(a, b) for r in rows for a, b in zip(r.got, r.want) if a != b][:2] == [] and sum(len(x) for r in rows for x in r.want) > 100


def test_lines_and_decisions_equal_the_expressions_alone(spark):
    df = spark.createDataFrame([(str(k), "s", "p", "a", "t", x) for k, x in enumerate(_texts())], "id string, session_id string, project string, source string, timestamp string, content string")
    every = df.select("id", F.posexplode(T.lines(F.col("content"))).alias("n", "raw")).withColumn("text", T.strip(F.col("raw")))
    want = every.where((F.length("text") >= 8) & F.substring("text", 1, 240).rlike(mining._any(P.PROBLEMS))).select("id", "n")
    got = mining._lines(df, P.PROBLEM_LITERALS).where((F.length("text") >= 8) & F.substring("text", 1, 240).rlike(mining._any(P.PROBLEMS))).select("id", "n")
    assert got.count() > 100 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    told = {r.id for r in mining.decision_sentences(df).collect()}
    assert told == {r.id for r in df.where(F.col("content").rlike(mining._any(P.DECISIONS))).collect()}
