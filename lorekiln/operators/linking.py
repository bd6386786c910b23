"""Clusters of word sets: sets of a Jaccard similarity are linked, and what links reach is one cluster.

Equal sets are one, whatever their number. Two sets of similarity t share one of the rarest n - ceil(t * n) + 1 words of the larger and one of the rarest n - ceil(2t / (1 + t) * n) + 1
words of the smaller, if all rank words alike, so only these are joined on. What is joined is numbers: the sets' words meet for the pairs alone whose sizes and whose places in the ranking
don't rule the similarity out. A word in very many prefixes is split: its sets are dealt out by classes of sizes, since sets of sizes too different are never alike, and then into blocks.

Clusters need no more links than hold them together. A first round holds each word's sets against the smallest of them; a second takes only pairs that the first one's links don't join.
Joins of what grows with the sets ask for a shuffle: a table's files are so much smaller than its rows that they would pass for small enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.operators import tables

#: Sets of a word and a class of sizes that meet in one task.
BLOCK = 4096


def _ranked(sets: DataFrame) -> DataFrame:
    """i, r (words, the rarest first), n of sets (i, tokens), and their other columns, as a table."""
    words = sets.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    ranked = sets.select("i", F.explode("tokens").alias("w")).join(words.hint("merge"), "w").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("r"))
    rest = [c for c in sets.columns if c not in ("i", "tokens")]
    ranked = ranked.select("i", F.transform("r", lambda x: x["w"]).alias("r"), F.size("r").alias("n"))
    return tables.kept(ranked.join(sets.select("i", *rest).hint("merge"), "i") if rest else ranked, "ranked-sets")


def _prefix(ranked: DataFrame, least: Column, *more: str) -> DataFrame:
    return ranked.select("i", "n", *more, F.posexplode(F.slice("r", F.lit(1), F.col("n") - F.ceil(least - 1e-9).cast("int") + 1)).alias("p", "w"))


def _class(n: Column, threshold: float) -> Column:
    """A set is met by those of its class of sizes and of the next."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(max(1 / threshold, 2.0))) + 1e-9).cast("int")


def _pairs(ranked: DataFrame, threshold: float, within: tuple[str, ...] = (), apart: str | None = None, root: str | None = None) -> DataFrame:
    """i, j, each pair once: sets that may be alike, equal in the columns `within`, of both sides of `apart` (0, 1) if it is given, and of different `root` if that is."""
    more = [*within, *(c for c in (apart, root) if c)]
    size = _class(F.col("n"), threshold)
    other = [F.col(f"{root}2")] if root else []
    side = [apart] if apart else []
    larger = _prefix(ranked, F.col("n") * threshold, *more).withColumn("m", size)
    smaller = _prefix(ranked, F.col("n") * (2 * threshold / (1 + threshold)), *more).withColumn("m", F.explode(F.array(size, size + 1)))
    if apart:
        smaller = smaller.withColumn(apart, 1 - F.col(apart))
    key = ["w", "m", *within, *side]
    many = larger.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select(*key, F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    many = F.broadcast(many)  # a row for each BLOCK of prefix words at most
    larger = larger.join(many, key, "left").withColumn("b", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))).drop("blocks")
    smaller = smaller.join(many, key, "left").withColumn("b", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    larger = larger.select(*key, "b", F.col("i").alias("j"), F.col("n").alias("n2"), F.col("p").alias("p2"), *[F.col(root).alias(f"{root}2") for _ in other])
    # for sets of both sides the smaller is told first, and of equals side 0's
    first = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & ((F.col(apart) == 1) if apart else (F.col("i") < F.col("j"))))
    # the words up to the shared one are no common ones before it, so what is left must be enough
    overlap = (F.col("n") + F.col("n2")) * (threshold / (1 + threshold)) - 1e-9
    enough = (F.col("n") >= F.col("n2") * threshold - 1e-9) & (1 + F.least(F.col("n") - F.col("p") - 1, F.col("n2") - F.col("p2") - 1) + F.least("p", "p2") >= overlap)
    met = smaller.join(larger.hint("merge"), [*key, "b"]).where(first & enough)
    return (met.where(F.col(root) != other[0]) if root else met).select("i", "j").distinct()


def _alike(pairs: DataFrame, ranked: DataFrame, threshold: float, *more: str) -> DataFrame:
    """The pairs whose words are as similar, i, j and more columns of each side (those of j with a 2 behind)."""
    of = lambda k, end: ranked.select(F.col("i").alias(k), F.col("r").alias(f"_r{end}"), *[F.col(c).alias(f"{c}{end}") for c in more]).hint("merge")
    both = pairs.join(of("i", ""), "i").join(of("j", "2"), "j")
    return both.where(T.jaccard(F.col("_r"), F.col("_r2")) >= threshold).drop("_r", "_r2")


def _numbered(sets: DataFrame, *columns: Column) -> DataFrame:
    return tables.kept(sets.select(F.monotonically_increasing_id().alias("i"), *columns, "tokens"), "numbered-sets")


def links(sets: DataFrame, threshold: float, key: str = "fingerprint") -> DataFrame:
    """a < b: the keys of any two sets (key, tokens, no key twice) that are at least that similar."""
    ranked = _ranked(_numbered(sets, F.col(key).alias("k")))
    alike = _alike(_pairs(ranked, threshold), ranked, threshold, "k")
    return alike.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"))


def across(left: DataFrame, right: DataFrame, threshold: float, within: tuple[str, ...]) -> DataFrame:
    """k, k2: the keys (k, tokens, no key twice) of a set of the left and one of the right that are at least that similar and equal in the columns `within`."""
    columns = [F.col("k"), *map(F.col, within)]
    sets = _numbered(left.select(*columns, F.lit(0).alias("side"), "tokens").unionByName(right.select(*columns, F.lit(1).alias("side"), "tokens")), *columns, F.col("side"))
    ranked = _ranked(sets)
    alike = _alike(_pairs(ranked, threshold, within, "side"), ranked, threshold, "k", "side")
    turned = F.col("side") == 0
    return alike.select(F.when(turned, F.col("k")).otherwise(F.col("k2")).alias("k"), F.when(turned, F.col("k2")).otherwise(F.col("k")).alias("k2"))


def clusters(sets: DataFrame, threshold: float, key: str = "fingerprint") -> DataFrame:
    """node, root: each set's key (key, tokens, no key twice) that is linked to any, and the smallest key that its links reach."""
    ranked = _ranked(_numbered(sets, F.col(key).alias("k")))
    some = _prefix(ranked, F.col("n") * threshold).withColumn("m", F.explode(F.array(_class(F.col("n"), threshold), _class(F.col("n"), threshold) + 1)))
    least = some.groupBy("w", "m").agg(F.min(F.struct("n", "i")).alias("x")).select("w", "m", F.col("x.i").alias("j"))
    star = some.join(least.hint("merge"), ["w", "m"]).where(F.col("i") != F.col("j")).select("i", "j").distinct()
    roots = reached(_alike(star, ranked, threshold).select(F.col("i").alias("a"), F.col("j").alias("b")))
    at = ranked.join(roots.withColumnRenamed("node", "i").hint("merge"), "i", "left").withColumn("root", F.coalesce("root", "i"))
    at = tables.kept(at, "rooted-sets")
    left = _alike(_pairs(at, threshold, root="root"), at, threshold, "root").select(F.col("root").alias("a"), F.col("root2").alias("b"))
    more = reached(left).select(F.col("node").alias("root"), F.col("root").alias("over"))
    at = at.select("k", "root").join(more.hint("merge"), "root", "left").select("k", F.coalesce("over", "root").alias("root"))
    names = at.groupBy("root").agg(F.min("k").alias("name"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return at.join(names.hint("merge"), "root").select(F.col("k").alias("node"), F.col("name").alias("root"))


def reached(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that the links a, b of each node reach.

    Each round every node takes its smallest neighbour's root, roots are followed twice, and links are drawn anew between roots; the number of links falls quickly.
    """
    edges = tables.kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
        for _ in range(2):
            step = tables.kept(step, "roots")
            step = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")).hint("merge"), "root").select("node", F.col("next").alias("root"))
        step = tables.kept(step, "roots")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = step if roots is None else tables.kept(roots.join(up.hint("merge"), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a, b = (step.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        drawn = edges.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = tables.kept(drawn.where("a <> b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
