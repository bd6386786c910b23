"""The corpus pipeline: quality rules, line dedup, near dedup, mixing, packing.

Each stage takes all that the one before it kept and returns the columns of documents; the last
returns where every piece of the mix lies. Rules and parameters are those of the operators, but that near
duplicates are told by five-word shingles.

Columns other than those of documents are left behind, whatever they are called, and an empty table gives an empty one. Equal
rows are as many rows in each stage: they stay or go together. What becomes of nulls is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import line_dedup, mixing, near_dedup, packing, quality, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject; null and empty texts have too few words and go. Rows without an id or a source are judged by their text."""
    shared.ship(spark)
    judged = quality.quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text. A document that loses all its lines stays, with an empty text.

    Null and empty texts stay as they are, with n_chars 0; rows without an id stay.
    """
    shared.ship(spark)
    kept = line_dedup.deduped(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates; rows of one id stay or go together.

    Null and empty texts link with nothing and stay; so do rows without an id, whatever they are like.
    """
    shared.ship(spark)
    gone = near_dedup.near_duplicates(docs, shingle=5).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    docs = docs.select(*COLUMNS)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them. Rows without a source are a source of their own, the last."""
    shared.ship(spark)
    return mixing.mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document; documents without words have one row, with no bin."""
    shared.ship(spark)
    return packing.packed(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Best-fit placement is sequential, and the quality score rests on 64-bit arithmetic; neither is SQL. The
#: tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
