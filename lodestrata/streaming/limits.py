"""Requests of a key within a sliding window, as a stream: state by key, timers, and an end for what is too old to count."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.tables import shared_dir

#: The state store that timers and maps need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Seconds of a row of state; rows that are taken in, of a state's row and of an answer at once.
SPAN, TAKEN, PART = 600, 1 << 20, 10_000


class Window(StatefulProcessor):
    """For each span of a key: how many requests each of its seconds had, and in parts those that wait until their second is over.

    One timer stands at the end of the first second that is waited for. When the watermark passes it, the requests of all seconds
    that are over are given, span by span and part by part, with the number of the window's up to them; spans that no waiting
    one can see are dropped. Python holds a part and the window's seconds, however many requests a key has.
    """

    def __init__(self, key: str, seconds: int) -> None:
        self.key, self.seconds = key, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "span bigint", "seconds array<bigint>, counts array<bigint>, parts bigint")
        self.waiting = handle.getMapState("waiting", "span bigint, part bigint", "at array<bigint>, ids array<bigint>")
        self.next = handle.getValueState("next", "ms bigint")

    def answer(self, name: str, ids, recent) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.array([name] * len(ids), "object"), "id": pd.array(ids, "int64"), "n_recent": pd.array(recent, "int64")})

    def wake(self, second: int) -> None:
        """A timer at a second's end, if none stands there or before."""
        ms = (second + 1) * 1000
        if not self.next.exists() or self.next.get()[0] > ms:
            self.next.update((ms,))
            self.handle.registerTimer(ms)

    def take(self, at: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        at, ids = at[order], ids[order]
        span = at // SPAN
        cut = np.flatnonzero(np.diff(span)) + 1
        for own, new in zip(np.split(at, cut), np.split(ids, cut)):
            s = int(own[0]) // SPAN
            seconds, counts, parts = self.held.getValue((s,)) if self.held.containsKey((s,)) else ([], [], 0)
            n = dict(zip(map(int, seconds), map(int, counts)))
            for second, k in zip(*np.unique(own, return_counts=True)):
                n[int(second)] = n.get(int(second), 0) + int(k)
            first = 0
            # the last part may have room
            if parts and self.waiting.containsKey((s, parts - 1)):
                old_at, old_ids = self.waiting.getValue((s, parts - 1))
                first = max(0, min(PART - len(old_at), len(own)))
                if first:
                    self.waiting.updateValue((s, parts - 1), ([*old_at, *own[:first].tolist()], [*old_ids, *new[:first].tolist()]))
            for i in range(first, len(own), PART):
                self.waiting.updateValue((s, parts), (own[i : i + PART].tolist(), new[i : i + PART].tolist()))
                parts += 1
            self.held.updateValue((s,), (list(n), list(n.values()), parts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, n, taken = None, 0, []
        for part in rows:
            taken.append((part["second"].to_numpy(np.int64), part["id"].to_numpy(np.int64)))
            n += len(part)
            first = min(int(part["second"].min()), first if first is not None else 1 << 62)
            if n >= TAKEN:
                self.take(*map(np.concatenate, zip(*taken)))
                n, taken = 0, []
        if taken:
            self.take(*map(np.concatenate, zip(*taken)))
        if first is not None:
            self.wake(first)
        yield self.answer("", [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over, name = timerValues.getCurrentWatermarkInMs() // 1000, str(key[0])
        spans = sorted(int(k[0]) for k in self.held.keys())
        second, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, ids, recent = None, [], []
        for s in spans:
            if s * SPAN >= over and first is not None:
                break
            seconds, counts, parts = self.held.getValue((s,))
            own = np.array(seconds, np.int64)
            order = np.argsort(own)
            # the window's seconds before this span, and its own
            near = second > s * SPAN - self.seconds
            second, count = np.concatenate((second[near], own[order])), np.concatenate((count[near], np.array(counts, np.int64)[order]))
            total = np.concatenate(([0], np.cumsum(count)))
            upto = lambda x: total[np.searchsorted(second, x, "right")]  # noqa: E731, B023
            for part in range(int(parts)):
                if not self.waiting.containsKey((s, part)):
                    continue
                at, own_ids = (np.array(x, np.int64) for x in self.waiting.getValue((s, part)))
                done = at < over
                if not done.all():
                    first = min(int(at[~done].min()), first if first is not None else 1 << 62)
                if done.any():
                    ids.append(own_ids[done])
                    recent.append(upto(at[done]) - upto(at[done] - self.seconds))
                    if done.all():
                        self.waiting.removeKey((s, part))
                    else:
                        self.waiting.updateValue((s, part), (at[~done].tolist(), own_ids[~done].tolist()))
                if sum(map(len, ids)) >= PART:
                    yield self.answer(name, np.concatenate(ids), np.concatenate(recent))
                    ids, recent = [], []
        seen = min(over, first if first is not None else over) - self.seconds
        for s in spans:
            if s * SPAN + SPAN - 1 <= seen:
                self.held.removeKey((s,))
        self.next.clear()
        if first is not None:
            self.wake(first)
        yield self.answer(name, np.concatenate(ids), np.concatenate(recent)) if ids else self.answer("", [], [])

    def close(self) -> None:
        """The store is Spark's."""


def requests_so_far(events: DataFrame, key: str, at: str, id_: str, seconds: int = 60, late: str = "0 seconds") -> DataFrame:
    """(key, id, n_recent) of a stream's events: requests of the same key in the `seconds` up to the end of each one's second.

    An event is given once its second is over by the watermark, which lets events be `late`; later ones are dropped. The state of
    a key is a row for each of its last spans, and of what waits a row for each PART. Needs the state store ROCKS.
    """
    rows = events.select(F.col(key).cast("string").alias(key), F.col(id_).cast("long").alias("id"), F.col(at).alias("at")).withWatermark("at", late)
    rows = rows.withColumn("second", F.unix_timestamp("at"))
    schema = f"{key} string, id bigint, n_recent bigint"
    return rows.groupBy(key).transformWithStateInPandas(Window(key, seconds), outputStructType=schema, outputMode="append", timeMode="eventtime")


def over_table(events: DataFrame, key: str, at: str, id_: str, seconds: int = 60) -> DataFrame:
    """requests_so_far of a whole table, taken as a stream until its end; what the watermark doesn't pass by then is left out."""
    spark, setting = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    path = f"{shared_dir(spark)}/lodestrata-limits-{uuid.uuid4().hex}"
    events.write.parquet(f"{path}/in")
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:
        counted = requests_so_far(spark.readStream.schema(events.schema).parquet(f"{path}/in"), key, at, id_, seconds)
        counted.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(counted.schema).parquet(f"{path}/out")
