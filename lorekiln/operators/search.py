"""Keyword (BM25), vector and hybrid retrieval.

Corpus figures (rows, mean length, rows with a phrase) are of the whole corpus, whatever the filters, and reach the
rows as scalar subqueries. Top k is TakeOrderedAndProject throughout: no full sort, no more than k rows from a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.operators import tables

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def filtered(rows: DataFrame, project: str | None = None, source: str | None = None, git_branch: str | None = None) -> DataFrame:
    """Equality filters, all of which hold; empty ones filter nothing."""
    for name, value in (("project", project), ("source", source), ("git_branch", git_branch)):
        if value:
            rows = rows.where(F.col(name) == value)
    return rows


def phrases(spark, query: str) -> list[list[str]]:
    """A query's phrases: the terms of each of its parts between white space; parts without terms say nothing."""
    parts = query.split()
    if not parts:
        return []
    row = spark.sql("SELECT 1").select(F.transform(F.array(*map(F.lit, parts)), T.terms).alias("p")).first()
    return [list(p) for p in row.p if p]


def places(joined: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in terms joined by spaces, with a space at either end; places may overlap."""
    return F.regexp_count(joined, F.lit(f"(?<= ){phrase[0]}(?= {''.join(t + ' ' for t in phrase[1:])})"))


def keyword_scores(rows: DataFrame, query: str, **filters: str | None) -> DataFrame:
    """Rows that have every phrase, and bm25 (lower is better)."""
    wanted = phrases(rows.sparkSession, query)
    if not wanted:
        return rows.withColumn("bm25", F.lit(None).cast("double")).where(F.lit(False))
    counted = rows.withColumn("_t", T.terms(F.col("content"))).withColumn("_j", F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" "))).withColumn("_dl", F.size("_t"))
    counted = counted.withColumns({f"_f{k}": places(F.col("_j"), p) for k, p in enumerate(wanted)}).drop("_t", "_j")
    corpus = counted.agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"n{k}") for k in range(len(wanted))])
    figure = lambda c: corpus.select(F.col(c).cast("double")).scalar()
    hits = filtered(counted, **filters).where(" AND ".join(f"_f{k} > 0" for k in range(len(wanted))))
    n, avgdl = figure("n"), figure("avgdl")
    score = F.lit(0.0)
    for k in range(len(wanted)):
        nk = figure(f"n{k}")
        score = score + gain(n, nk, F.col(f"_f{k}").cast("double"), F.col("_dl"), avgdl)
    return hits.withColumn("bm25", -score).select(*rows.columns, "bm25")


def gain(n: Column, having: Column, tf: Column, length: Column, mean: Column) -> Column:
    """What one phrase adds to a row's score."""
    idf = F.log((n - having + 0.5) / (having + 0.5))
    return F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def keyword(rows: DataFrame, query: str, k: int = 10, index: str | None = None, **filters: str | None) -> DataFrame:
    """The best k rows that have every phrase, from the rows' texts, or from a stored index of them."""
    if index:
        from lorekiln.operators import index as stored

        return rows.join(F.broadcast(stored.keyword(rows.sparkSession, index, query, k, **filters)), "id")  # k rows
    return keyword_scores(rows, query, **filters).orderBy("bm25", "id").limit(k)


def build_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored form of the same figures: lengths (id, dl) and postings (term, id, tf, positions)."""
    terms = rows.select("id", T.terms(F.col("content")).alias("t"))
    found = terms.select("id", F.posexplode("t").alias("p", "term"))
    return terms.select("id", F.size("t").alias("dl")), found.groupBy("term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("p")).alias("positions"))


def missing_from_index(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    return rows.join(lengths.select("id"), "id", "left_anti")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic(rows: DataFrame, vector: list[float], k: int = 5, min_relevance: float = 0.0, **filters: str | None) -> DataFrame:
    """The k nearest rows by `embedding`, with distance (1 - cosine); exact."""
    wanted = F.array(*[F.lit(float(x)) for x in vector])
    near = filtered(rows, **filters).withColumn("distance", 1 - cosine(F.col("embedding"), wanted)).orderBy("distance", "id").limit(k)
    return near.where(1 - F.col("distance") >= min_relevance) if min_relevance > 0 else near


def normalized(value: Column, over) -> Column:
    """0 to 1 between a frame's least and largest value; 1 if they are equal."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return F.when(hi <= lo, 1.0).otherwise((value - lo) / (hi - lo))


def hybrid(rows: DataFrame, query: str, vector: list[float], k: int = 5, weight: float = 0.5, min_relevance: float = 0.0, index: str | None = None, **filters: str | None) -> DataFrame:
    """Both sides' best max(3k, 10), each normalised over its own frame, joined by id. The windows go over those rows only."""
    fetch = max(3 * k, 10)
    every = Window.partitionBy()
    near = semantic(rows, vector, fetch, min_relevance, **filters)
    near = near.select("id", "distance", normalized(1 - F.col("distance"), every).alias("sem_score"), F.row_number().over(Window.orderBy("distance", "id")).alias("sem_rank"))
    if index:
        from lorekiln.operators import index as stored

        said = stored.keyword(rows.sparkSession, index, query, fetch, **filters)
    else:
        said = keyword(rows, query, fetch, **filters)
    said = said.select("id", "bm25", normalized(-F.col("bm25"), every).alias("kw_score"), F.row_number().over(Window.orderBy("bm25", "id")).alias("kw_rank"))
    both = near.join(said, "id", "full_outer").fillna(0.0, ["sem_score", "kw_score"])
    both = both.withColumn("score", weight * F.col("sem_score") + (1 - weight) * F.col("kw_score"))
    top = both.orderBy(F.desc("score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("kw_rank")).limit(k)
    top = tables.kept(top, "hits")
    # told by id, so that rows which are a join are looked for below it, before their texts move
    return rows.where(F.col("id").isin([r.id for r in top.select("id").collect()])).join(F.broadcast(top), "id")  # k rows


def age_days(timestamp: Column, now: str) -> Column:
    """Days from an ISO time to now, 0 at least; null if it can't be read."""
    at = F.try_to_timestamp(F.regexp_replace(timestamp, "Z$", ""))
    return F.greatest((F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(at)) / 86_400_000_000, F.lit(0.0))


def decayed(hits: DataFrame, now: str, k: int, half_life: float = 30.0) -> DataFrame:
    """Ranks chosen hits again by score * exp(-age / half_life)."""
    base = F.coalesce(*[F.col(c) for c in ("score",) if c in hits.columns], *[1 - F.col(c) for c in ("distance",) if c in hits.columns], F.lit(0.5))
    factor = F.coalesce(F.exp(-age_days(F.col("timestamp"), now) / half_life), F.lit(1.0))
    return hits.withColumn("decayed", base * factor).orderBy(F.desc("decayed"), "id").limit(k)


def deduped(hits: DataFrame, rank: list[Column]) -> DataFrame:
    """The first hit of each text, told by its first 100 characters without case and spacing."""
    w = Window.partitionBy("_key").orderBy(*rank)
    return hits.withColumn("_key", T.dedup_key(F.col("content"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def search(rows: DataFrame, query: str, vector: list[float] | None = None, mode: str = "hybrid", k: int = 5, min_relevance: float = 0.0, weight: float = 0.5, now: str | None = None, half_life: float = 30.0, index: str | None = None, **filters: str | None) -> DataFrame:
    if mode == "semantic":
        hits = semantic(rows, vector, k, min_relevance, **filters)
    elif mode == "keyword":
        hits = keyword(rows, query, k, index, **filters).withColumn("distance", F.lit(None).cast("double"))
    elif mode == "hybrid":
        hits = hybrid(rows, query, vector, k, weight, min_relevance, index, **filters)
    else:
        raise ValueError(f"mode {mode!r} is none of semantic, keyword, hybrid")
    return decayed(hits, now, k, half_life) if now else hits


def checked(query: str, project: str = "", source: str = "", top_k: object = 5) -> tuple[str, str, str, int]:
    """Bounds on what a caller may ask for."""
    for name, value, most in (("query", query, 10_000), ("project", project, 200), ("source", source, 100)):
        if not isinstance(value, str):
            raise ValueError(f"{name} must be a string")
        if len(value) > most:
            raise ValueError(f"{name} is longer than {most} characters")
    try:
        k = int(top_k)
    except (TypeError, ValueError):
        k = 5
    return query, project, source, min(max(k, 1), 50)


def lite(rows: DataFrame, query: str, vector: list[float], now: str, k: int = 10, index: str | None = None) -> DataFrame:
    """id, preview, decayed."""
    hits = search(rows, query, vector, k=k, min_relevance=0.25, now=now, index=index)
    return deduped(hits, [F.desc("decayed"), F.col("id")]).select("id", T.preview(F.col("content")).alias("preview"), "decayed")


def context(rows: DataFrame, query: str, vector: list[float], session: str, k: int = 5, keep: int = 3, min_relevance: float = 0.35, most: int = 220, index: str | None = None, **filters: str | None) -> DataFrame:
    """Snippets for a prompt, none from the session that asks."""
    hits = hybrid(rows, query, vector, k, min_relevance=min_relevance, index=index, **filters).where(F.col("session_id") != session)
    return hits.orderBy(F.desc("score"), "id").limit(keep).select("id", "project", "source", "timestamp", T.snippet(F.col("content"), most).alias("snippet"))
