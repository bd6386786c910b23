"""Rows that are a join of texts and vectors: the ids of the hits are looked for below the join."""

from lorekiln.operators import search


def test_hits_are_sought_below_the_join(spark, tmp_path):
    spark.createDataFrame([(str(k), f"the text {k} and more", "p") for k in range(40)], "id string, content string, project string").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(str(k), [float(k), 1.0]) for k in range(40)], "id string, embedding array<double>").write.parquet(str(tmp_path / "v"))
    rows = spark.read.parquet(str(tmp_path / "t")).join(spark.read.parquet(str(tmp_path / "v")).hint("merge"), "id")
    out = search.hybrid(rows, "the and", [1.0, 1.0], 3)
    found = sorted(r.id for r in out.collect())
    assert len(found) == 3 and out.columns[:3] == ["id", "content", "project"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.rindex("Join Inner") :].count(" IN (") == 3  # on either side of the rows' own join, and on the hits
