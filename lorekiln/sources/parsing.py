"""What the readers share: order-bound steps as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions import text as T


def distinct_user_turns(rows: DataFrame, key: str = "session_id", order: str = "n", most: int = 200) -> DataFrame:
    """Rows without the user's repeats: those that begin like an earlier turn of the user in the session."""
    human = F.col("role") == "human"
    w = Window.partitionBy(key, human, F.when(human, F.substring(T.strip(F.col("content")), 1, most))).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where(~human | (F.col("_r") == 1)).drop("_r")


def last_assistant(key: str = "session_id", order: str = "n") -> Column:
    """The place of the last assistant turn up to each row."""
    return F.last(F.when(F.col("role") == "assistant", F.col(order)), ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def running_session(begins: Column, key: list[str], order: list[str]) -> Column:
    """Numbers sessions by a running count of their first rows; 0 before the first."""
    return F.sum(F.when(begins, 1).otherwise(0)).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def first_said(c: Column, order: Column) -> Column:
    """The first value that isn't empty."""
    return F.min_by(F.when(c != "", c), F.when(c != "", order))


def project_of_slug(slug: Column) -> Column:
    """The last telling part of a folder name that stands for a path."""
    dull = ("Users", "Documents", "GitHub", "Projects", "Code", "Home", "home", "src", "")
    return F.coalesce(F.try_element_at(F.filter(F.split(slug, "-"), lambda x: ~x.isin(*dull)), F.lit(-1)), slug)


SESSION = ("session_id", "source", "project", "git_branch", "started_at", "ended_at", "working_directory", "summary", "files", "exchanges")


def exchange_rows(sessions: DataFrame) -> DataFrame:
    """sessions as the rows that ingest takes."""
    return sessions.select("session_id", "source", "project", "git_branch", "started_at", "files", F.explode("exchanges").alias("x")).select("session_id", "source", "project", "git_branch", "started_at", "files", "x.*")
