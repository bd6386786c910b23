"""Chunks of sessions of any length: `ingest.chunks` without a session's turns in one row.

Turns are sorted by session and place over range partitions, so that a long session is many ranges. How a range is cut rests on what it
begins with only by the tokens that the open chunk holds, a number up to the limit: so each range gives a table from held tokens to held tokens and
cuts, tables of a session's ranges are followed one after another (thin rows, a few for each partition), and then each range
is cut on its own, its entry known. Texts are sorted once, joined with their chunk's number, and grouped by chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.operators import ingest, tables

FRESH = -1  # no turn of the session is held yet


def _successors(tokens, most: int):
    """For each turn the next chunk's first turn, if a chunk begins with it; len(tokens) if none begins in the range. Exact sums, binary search."""
    import numpy as np

    sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    here = np.arange(len(tokens), dtype=np.int64)
    # the first turn that makes the sum larger than the limit, but never the chunk's own first
    return np.maximum(np.searchsorted(sums, sums[:-1] + most, side="right") - 1, here + 1), sums


def _cut(tokens, held: int, most: int):
    """The turns of a range that begin a chunk, where `held` tokens are open before it."""
    import numpy as np

    after, sums = _successors(tokens, most)
    at = 0 if held == FRESH else int(np.searchsorted(sums, most - held, side="right")) - 1 if held <= most else 0
    out = []
    while at < len(tokens):
        out.append(at)
        at = int(after[at])
    return out


def _table(tokens, most: int):
    """For held tokens of 0 to most + 1 (that or more): tokens held after the range, and chunks begun in it."""
    import numpy as np

    after, sums = _successors(tokens, most)
    size = len(tokens)
    jump = np.append(after, size)
    begun = np.append(np.ones(size, np.int64), 0)
    last = np.append(np.arange(size, dtype=np.int64), size)  # the last chunk that begins on the way
    while (jump[:-1] < size).any():  # path doubling within the range
        begun = begun + begun[jump]
        last = np.where(jump < size, last[jump], last)
        jump = jump[jump]
    held = np.arange(most + 2, dtype=np.int64)
    first = np.where(held <= most, np.searchsorted(sums, most - held, side="right") - 1, 0)
    left = np.where(first < size, sums[-1] - sums[np.minimum(last[first], size)], held + sums[-1])
    return np.minimum(left, most + 1).astype(np.int32), begun[first]


def _fold(most: int):
    def fold(pdf):
        """The entry of each range of one session: tokens held before it, chunks begun before it."""
        import pandas as pd

        held, n, out = FRESH, 0, []
        for r in pdf.sort_values("part").itertuples():
            out.append((r.session, r.part, held, n))
            if held == FRESH:
                held, n = int(r.fresh_left), n + int(r.fresh_begun)
            else:
                held, n = int(r.left[held]), n + int(r.begun[held])
        return pd.DataFrame(out, columns=["session", "part", "held", "n_before"])

    return fold


def chunks(exchanges: DataFrame, most: int = ingest.MAX_TOKENS) -> DataFrame:
    """The same rows as ingest.chunks. A null started_at, project or source makes their session a session of its own, as grouping does.

    What one task has at once is a range's token counts, and a chunk's texts. A range is a partition of the sort (spark.sql.shuffle.partitions of
    them at most), so that the setting bounds it; turns of one session and one n aren't parted. Turns of negative length don't exist.
    """
    import pandas as pd

    key = list(ingest.SESSION)
    # a session's key in few bytes: absent and empty fields are told apart, since to_json leaves out nulls
    session = F.unhex(F.sha2(F.to_json(F.struct(*key)), 256))
    order = ["session", "n", "text", "tokens", "timestamp"]
    rows = ingest.exchange_rows(exchanges).select(session.alias("session"), *key, "n", "text", "tokens", "timestamp")
    rows = rows.repartitionByRange("session", "n").sortWithinPartitions(*order)
    rows = tables.kept(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "turns")
    thin = rows.select("session", "part", "at", "tokens")

    # sessions of more than one range; a border between partitions is in one session, so there are fewer of them than partitions
    long = thin.groupBy("session").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("session")

    def tell(pdf):
        tokens = pdf.sort_values("at")["tokens"].to_numpy("int64")
        left, begun = _table(tokens, most)
        starts = _cut(tokens, FRESH, most)
        fresh = min(int(tokens[starts[-1] :].sum()), most + 1)
        return pd.DataFrame([(pdf["session"].iloc[0], int(pdf["part"].iloc[0]), left, begun, fresh, len(starts))], columns=["session", "part", "left", "begun", "fresh_left", "fresh_begun"])

    told = thin.join(long, "session").groupBy("session", "part").applyInPandas(tell, "session binary, part int, left array<int>, begun array<bigint>, fresh_left int, fresh_begun bigint")
    entries = told.groupBy("session").applyInPandas(_fold(most), "session binary, part int, held int, n_before bigint")

    def label(pdf):
        """Chunk numbers of the turns of one range partition, of which sessions are runs."""
        import numpy as np

        pdf = pdf.sort_values("at")
        ids = pdf["session"].to_numpy()
        tokens = pdf["tokens"].to_numpy("int64")
        held, before = pdf["held"].to_numpy("int64"), pdf["n_before"].to_numpy("int64")
        edges = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        begins = np.zeros(len(ids), np.int64)
        number = np.zeros(len(ids), np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(ids)), strict=True):
            begins[np.asarray(_cut(tokens[a:b], int(held[a]), most), np.int64) + a] = 1
            number[a:b] = before[a] + np.cumsum(begins[a:b]) - 1
        return pd.DataFrame({"at": pdf["at"].to_numpy(), "chunk_index": number.astype("int32"), "begins": begins.astype(bool)})

    # a session that is one range begins fresh
    known = thin.join(entries, ["session", "part"], "left").fillna({"held": FRESH, "n_before": 0})
    labels = tables.kept(known.groupBy("part").applyInPandas(label, "at bigint, chunk_index int, begins boolean"), "labels")
    piece = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    by = rows.join(labels, "at").groupBy("session", "chunk_index").agg(*[F.first(c).alias(c) for c in key], F.array_join(piece, "\n\n").alias("content"))
    # a chunk is closed by the turn that opens the next, and takes that one's time; these rows hold no text, and chunks already lie by the join's key
    opening = rows.select("session", "at", "timestamp").join(labels.where("begins AND chunk_index > 0"), "at")
    closing = opening.select("session", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("timestamp").alias("closed"))
    whole = by.join(closing, ["session", "chunk_index"], "left")
    time = F.when(F.col("closed") != "", F.col("closed")).otherwise(F.col("started_at"))
    content = F.when(F.col("chunk_index") == 0, F.concat(ingest.header(), F.col("content"))).otherwise(F.col("content"))
    return whole.select(
        ingest.chunk_id(F.col("session_id"), F.col("chunk_index")).alias("id"), "session_id", "source", "project", F.coalesce("git_branch", F.lit("")).alias("git_branch"), content.alias("content"), time.alias("timestamp"), "chunk_index"
    )
