"""Connected components by repeated contraction, in DataFrame operations only.

Each round every vertex hooks on to its smallest neighbour, parents are followed four steps up, and
the edges are redrawn between the parents; loops and repeats go. Hooks are edges, so a contracted
graph has the same components, and the smallest vertex of each is never renamed. The edge table
shrinks geometrically; each round ends in a table in the shared folder, so nothing is recomputed
from the start, and a hub of any degree is met by map-side minima only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import shared


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp: the smallest vertex reachable from each vertex of an edge. Null ends and loops count for nothing."""
    given, edges, label = edges, _tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp"))
        up = shared.cut(up, "hooks")
        for _ in range(2):
            nxt = up.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
            old, up = up, shared.cut(up.join(nxt, "comp").select("node", F.col("over").alias("comp")), "hooks")
            shared.drop(old)
        if label is not None:
            nxt = up.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
            old, label = label, shared.cut(label.join(nxt, "comp", "left").select("node", F.coalesce("over", "comp").alias("comp")), "labels")
            shared.drop(old)
        of_a = up.select(F.col("node").alias("a"), F.col("comp").alias("pa"))
        of_b = up.select(F.col("node").alias("b"), F.col("comp").alias("pb"))
        old, edges = edges, _tidy(edges.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
        shared.drop(old, up if label is not None else None)
        label = up if label is None else label
    shared.drop(edges)
    if label is None:
        return given.select(F.col(a).alias("node"), F.col(a).alias("comp")).limit(0)
    return label


def _tidy(edges: DataFrame) -> DataFrame:
    edges = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return shared.cut(edges.distinct(), "edges")
