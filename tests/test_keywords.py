"""The most frequent words are counted within a group's row: no row a word is made, shuffled or held in a table of counts."""

from lorekiln.operators import ingest


def test_words_are_counted_where_they_are(spark):
    rows = [("a", 1, "zeta alpha the the the"), ("a", 0, "Beta alpha zeta ZETA gamma delta"), ("b", 0, "the and"), ("c", 0, None), (None, 0, "omega omega psi"), ("d", 0, " ".join(f"w{k:03}" for k in range(300)) + " w299 ok")]
    out = ingest.keywords(spark.createDataFrame(rows, "id string, n_order int, content string"), ["id"], "content", 3)
    assert {r.id: list(r.keywords) for r in out.collect()} == {"a": ["zeta", "alpha", "beta"], None: ["omega", "psi"], "d": ["w299", "w000", "w001"]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Generate" not in plan and "Window" not in plan
