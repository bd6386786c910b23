r"""Mixing sources to target weights by hash thresholds found in histograms; DataFrame operations only.

A source gets budget * its weight's share of all words, but at most `most` times its own words; what
is over is shared again by weight until none is above. The fixed point is found in closed form: with
sources ordered by cap / weight the capped ones are a prefix.

A source takes each document floor(target / size) times, and once more those whose 60-bit hash lies
below the source's threshold. That threshold comes from histograms: words are summed by source and hash
bucket, the bucket in which the running sum passes the budget is refined by the next ten bits, and
so on until it holds one document, which is taken if that comes nearer. No row is sorted; a
histogram has 1024 rows a source at most, and only rows of boundary buckets are looked at again.

The hash is of the id and the text, so a run repeats exactly and an id that many rows share
doesn't move them together.

Defined cases: null and empty texts have size 0 and are taken with 0 words; a null source is a
source of its own, the last one; a null id hashes like an empty string; repeated rows are taken
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.llm import shared

WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2
BITS, STEP = 60, 10
#: The table of sources is sent to all executors up to this many rows; beyond, it is joined by source.
SENT_SOURCES = 50_000
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """i, source, size, h: nothing of the text but its size and its hash."""
    text = F.col(text_col).cast("string")
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    h = F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")
    return docs.select(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), h.alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, words, target. One row a source goes through the two windows without a partition."""
    by = rows.groupBy("source").agg(F.sum("size").alias("words"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("w", pick.cast("double")).withColumn("cap", F.col("words").cast("double") * most)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_words = F.sum("words").over(every) * F.lit(float(budget))
    by = by.select("*", all_words.alias("b"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("c"), (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("r"))
    by = by.withColumn("full", F.col("w") * (F.col("b") - F.col("c")) / F.col("r") >= F.col("cap"))
    left = (F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0)))
    over = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return by.select("source", "words", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * left / over).alias("target"))


def _of_source(rows: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    table = table.withColumnRenamed("source", "s")
    if n_sources <= SENT_SOURCES:
        table = F.broadcast(table)
    return rows.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def thresholds(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """source, words, target, repeats, below: each source takes its documents `repeats` times, and once more those with h < below."""
    repeats = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    state = plan.select("source", "words", "target", repeats.alias("repeats"))
    # need: words that the extra round takes; at: hash prefix of the boundary bucket; done: words below it
    state = state.withColumns({"need": F.col("target") - F.col("repeats") * F.col("words"), "at": F.lit(0).cast("long"), "done": F.lit(0).cast("long"), "held": F.lit(0).cast("long"), "docs": F.lit(2).cast("long")})
    state = shared.cut(state, "mix-plan")
    for shift in range(BITS - STEP, -1, -STEP):
        here = _of_source(rows, state.select("source", "at"), n_sources).where(F.shiftright("h", shift + STEP) == F.col("at"))
        counts = here.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        counts = counts.withColumn("upto", upto)
        found = _of_source(counts, state.select("source", "need", "done"), n_sources).where(F.col("done") + F.col("upto") > F.col("need"))
        first = found.groupBy("source").agg(F.min(F.struct("bucket", "n", "upto", "docs")).alias("x")).withColumnRenamed("source", "s")
        state = state.drop("docs", "held").join(first, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        # a source without words has no boundary: its prefix stays 0
        state = state.withColumns({"at": F.coalesce("x.bucket", F.shiftleft("at", STEP)), "done": F.col("done") + F.coalesce(F.col("x.upto") - F.col("x.n"), F.lit(0)), "held": F.coalesce("x.n", F.lit(0)), "docs": F.coalesce("x.docs", F.lit(0))}).drop("x")
        state = shared.cut(state, "mix-plan")
        if (state.agg(F.max("docs")).first()[0] or 0) <= 1:
            break
    nearer = (F.col("held") > 0) & (F.col("need") - F.col("done") >= F.col("held") / 2)
    return state.select("source", "words", "target", "repeats", F.shiftleft(F.col("at") + nearer.cast("long"), shift).alias("below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """i, source, size, source_size, target, copies, taken: one row for each row of docs."""
    rows = shared.cut(shared.compact(sized(docs, id_col, source_col, text_col)), "mix-sizes")
    plan = shared.cut(targets(rows, weights, budget, most), "mix-targets")
    n_sources = plan.count()
    out = _of_source(rows, thresholds(rows, plan, n_sources), n_sources)
    copies = F.col("repeats") + (F.col("h") < F.col("below")).cast("long")
    return out.select("i", "h", "source", "size", F.col("words").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them."""
    rows = shared.cut(shared.compact(sized(docs, id_col, source_col, text_col)), "mix-sizes")
    plan = shared.cut(targets(rows, weights, budget, most), "mix-targets")
    n_sources = plan.count()
    own, (h, copy) = docs.columns, shared.fresh([*docs.columns, "s", "words", "target", "repeats", "below"], "h", "copy")
    text = F.col(text_col).cast("string")
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    limits = thresholds(rows, plan, n_sources)
    s, repeats, below = shared.fresh([*own, h, copy], "s", "repeats", "below")
    limits = limits.select(F.col("source").alias(s), F.col("repeats").alias(repeats), F.col("below").alias(below))
    if n_sources <= SENT_SOURCES:
        limits = F.broadcast(limits)
    keyed = docs.withColumn(h, F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long"))
    out = keyed.join(limits, F.col(source_col).cast("string").eqNullSafe(F.col(s)))
    times = F.col(repeats) + (F.col(h) < F.col(below)).cast("long")
    out = out.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))))
    return out.select(*[F.col(f"`{c}`") for c in own])
