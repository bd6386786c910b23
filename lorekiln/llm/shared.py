"""What the operators share: the cluster's shared folder, lineage cuts and bounded Arrow slices."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: it sorts before every id.
NULL_ID = -(2**63)
#: Text that a vectorised step looks at together; one longer document is a slice of its own.
SLICE_BYTES = 1 << 20


#: Bytes below a plan for each partition that compact leaves.
COMPACT_BYTES = 32 << 20


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir; all of an application's go when it ends.

    Where the setting is unset, a local master gets a temporary folder; on a cluster that is an error, since executors and driver share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
        base = spark.sparkContext.getCheckpointDir()
    run = f"{base.rstrip('/')}/lorekiln/{spark.sparkContext.applicationId}"
    if run not in _runs:
        store, path = _store(spark, run)
        store.mkdirs(path)
        store.deleteOnExit(path)
        _runs.add(run)
    return f"{run}/{tag}-{uuid.uuid4().hex}"


_runs: set[str] = set()


def _store(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def compact(df: DataFrame) -> DataFrame:
    """What a scan makes, in fewer partitions, so that small tables don't become many small files: one for each COMPACT_BYTES of what the
    plan reads, but four a core at least. Not for what a shuffle makes: adaptive execution sizes that more evenly."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.coalesce(min(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // COMPACT_BYTES)), 2**31 - 1))


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it back, so a lost executor costs one scan."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Removes tables made by cut, once all that was made from them is a table itself."""
    for table in tables:
        if path := table is not None and table.__dict__.pop("_cut_path", None):
            store, at = _store(table.sparkSession, path)
            store.delete(at, True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed but its folder is visible."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def id_or_lowest(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def null_if_lowest(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that column holds about `most` bytes in each."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array):
    """The bytes of a string or binary column and the offsets of its rows (null: empty), without a copy where there are no nulls."""
    import numpy as np
    import pyarrow.compute as pc

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind, step = (np.int64, 8) if wide else (np.int32, 4)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * step).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until none clashes with those taken."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


#: Bits of a filter over hashes: its words, this / 64 at the most whatever the input, are what is broadcast.
FILTER_BITS = 1 << 24


def _place(h: Column) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(FILTER_BITS))


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), _place(h).bitwiseAND(F.lit(63)).cast("int"))


def filter_words(hashes: DataFrame, h: str) -> DataFrame:
    """The words of a filter that has a bit for each of the hashes."""
    return hashes.select(F.shiftright(_place(F.col(h)), 6).alias("word"), _bit(F.col(h)).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def marked(rows: DataFrame, words: DataFrame, h: str, name: str) -> DataFrame:
    """rows with `name`: whether the filter may have the row's hash. False is certain; the more hashes it has, the more rows are true in vain."""
    word, bits = fresh([*rows.columns, name], "word", "bits")
    sent = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    out = rows.join(sent, F.shiftright(_place(F.col(h)), 6) == F.col(word), "left")
    return out.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(_bit(F.col(h))) != 0, F.lit(False))).drop(word, bits)
