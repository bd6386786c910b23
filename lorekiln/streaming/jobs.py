"""Incremental ingest and throttling, as streams and as batches with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """Files that arrive in a folder, each once."""
    return spark.readStream.format(fmt).schema(schema).load(path)


def append_new(stream: DataFrame, store: str, checkpoint: str):
    """Writes rows whose id the store doesn't have; the first write wins, within a batch and over batches.

    A batch that is run again finds what it wrote and adds nothing.
    """
    from lorekiln.operators.ingest import append

    return stream.writeStream.foreachBatch(lambda batch, _: append(batch, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_each(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key within the time that late rows are waited for."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def throttled(rows: DataFrame, key: str, time: str, order: str, seconds: float) -> DataFrame:
    """Rows that come at least `seconds` after the last row of their key that passed. Streams over sorted partitions; no key is gathered."""
    names = rows.columns

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = object(), None
        for b in batches:
            good = []
            for k, t in zip(b[key].tolist(), b["_us"].tolist(), strict=True):
                if k != current:
                    current, last = k, None
                good.append(last is None or t - last >= seconds * 1e6)
                last = t if good[-1] else last
            yield b.loc[good, names]

    timed = rows.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    return timed.repartition(key).sortWithinPartitions(key, time, order).mapInPandas(each, rows.schema)


def throttle_stream(stream: DataFrame, key: str, time: str, seconds: float, forget: float = 4.0, late: str = "10 minutes") -> DataFrame:
    """key, passed; a key's state is dropped `forget` times the interval after its last row, by the watermark. Rows that are later than `late` don't pass.

    A timeout of processing time would ask for one batch after another, so that a run over what is there never ended.
    """

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for b in batches for t in b["_us"].tolist())
        last, out = state.get[0] if state.exists else None, []
        for t in times:
            if last is None or t - last >= seconds * 1e6:
                last = t
                out.append(t)
        state.update((last,))
        state.setTimeoutTimestamp(times[-1] // 1000 + max(1, int(seconds * forget * 1000)))
        yield pd.DataFrame({key: [k[0]] * len(out), "passed": pd.to_datetime(pd.Series(out, dtype="int64"), unit="us")})

    kind = stream.schema[key].dataType.simpleString()
    timed = stream.select(key, F.col(time).cast("timestamp").alias("_at")).where("_at IS NOT NULL").withWatermark("_at", late).withColumn("_us", F.unix_micros("_at"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, passed timestamp", "last bigint", "append", "EventTimeTimeout")
