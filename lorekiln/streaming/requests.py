"""Which requests for what was said about a file are answered: each path at most once in a while, by owner, as a stream and as a batch.

requests: owner, request, path, at (timestamp), block (the answer; null if nothing was found). Only a request that has an answer counts
against later ones of its path. An owner's state is the newest `most` paths of the last `forget` intervals, whatever the number of requests.
Of one owner and one batch, requests go by time, then by request. One without a path or a time is never answered; a null owner is an owner.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECONDS, MOST, FORGET = 60.0, 200, 4.0


class Passed:
    """When each path of an owner was last answered (microseconds)."""

    def __init__(self, seconds: float, most: int, forget: float, told: dict[str, int] | None = None):
        self.wait, self.most, self.keep = int(seconds * 1e6), most, int(seconds * forget * 1e6)
        self.told = dict(told or {})

    def answers(self, path: str, at: int) -> bool:
        last = self.told.get(path)
        if last is not None and at - last < self.wait:
            return False
        self.told[path] = at
        fresh = {p: t for p, t in self.told.items() if at - t < self.keep}
        if len(fresh) > self.most:
            fresh = dict(sorted(fresh.items(), key=lambda x: -x[1])[: self.most])
        self.told = fresh
        return True


def _timed(requests: DataFrame) -> DataFrame:
    return requests.where("block IS NOT NULL AND coalesce(path, '') <> '' AND at IS NOT NULL").withColumn("_us", F.unix_micros(F.col("at").cast("timestamp")))


def answered(requests: DataFrame, seconds: float = SECONDS, most: int = MOST, forget: float = FORGET) -> DataFrame:
    """The requests that are answered, all columns kept. One sort by owner and time; an owner's requests stream past its state and are never gathered."""
    names = requests.columns

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, state = object(), None
        for b in batches:
            good = []
            for o, path, us in zip(b["_owner"].tolist(), b["path"].tolist(), b["_us"].tolist(), strict=True):
                if o != owner:
                    owner, state = o, Passed(seconds, most, forget)
                good.append(state.answers(path, us))
            yield b.loc[good, names]

    rows = _timed(requests).withColumn("_owner", F.to_json(F.struct("owner")))  # a null owner equals itself, which NaN doesn't
    return rows.repartition("_owner").sortWithinPartitions("_owner", "_us", "request").mapInPandas(each, requests.schema)


def answered_stream(requests: DataFrame, seconds: float = SECONDS, most: int = MOST, forget: float = FORGET, late: str = "10 minutes") -> DataFrame:
    """owner, request, path, at, block of the requests of a stream that are answered.

    State is committed with its batch, after the sink took the batch: one that fails is run again from the state before it, so that what wasn't
    delivered isn't held back. Requests that come later than `late` after others aren't answered; an owner's state goes when all its paths are
    forgotten before the time that is still waited for. That is event time: with timeouts of processing time a run over what is there wouldn't end.
    """

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        told = Passed(seconds, most, forget, dict(zip(*map(list, state.get), strict=True)) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["_us", "request"], kind="stable")
        good = [told.answers(p, t) for p, t in zip(rows["path"].tolist(), rows["_us"].tolist(), strict=True)]
        state.update((list(told.told), list(told.told.values())))
        state.setTimeoutTimestamp(int(rows["_us"].max()) // 1000 + max(1, int(seconds * forget * 1000)))
        yield rows.loc[good, names]

    requests = requests.select("owner", "request", "path", F.col("at").cast("timestamp").alias("at"), "block")
    names = requests.columns
    timed = _timed(requests).withColumn("_owner", F.to_json(F.struct("owner"))).withWatermark("at", late)
    return timed.groupBy("_owner").applyInPandasWithState(step, requests.schema, "paths array<string>, times array<bigint>", "append", "EventTimeTimeout")
