"""The stateful limiter against the window over a table, late events, and a restart between batches."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from lodestrata.streaming.limits import PART, ROCKS, SPAN, Window, requests_so_far
from pyspark.sql import functions as F

SCHEMA = "event_id long, kind string, ts timestamp"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, path, n, rows):
    df = spark.createDataFrame(rows, "event_id long, kind string, t long").select("event_id", "kind", F.timestamp_seconds("t").alias("ts"))
    df.coalesce(1).write.parquet(f"{path}/{n}")


def run(spark, path, out, checkpoint, seconds, late="0 seconds"):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    q = requests_so_far(events, "kind", "ts", "event_id", seconds, late).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return sorted(map(tuple, spark.read.schema("kind string, id long, n_recent long").parquet(out).collect()))


def plain(rows, seconds):
    return sorted((k, i, sum(k == k2 and t - seconds < t2 <= t for _, k2, t2 in rows)) for i, k, t in rows)


def test_batches_and_a_restart(spark, tmp_path, rocks):
    """Windows reach over batches and over a restart from the checkpoint; what is late is dropped; every event is given once."""
    path, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    first = [(i, "ab"[i % 2], 1000 + i // 3) for i in range(60)]
    second = [(100 + i, "ab"[i % 3 == 0], 1015 + 7 * i) for i in range(12)]
    put(spark, path, 0, first)
    got = run(spark, path, out, cp, 20)
    # the last second is not over
    assert got == [x for x in plain(first, 20) if x[1] < 57]
    put(spark, path, 1, [*second, (200, "a", 900)])
    put(spark, path, 2, [(300, "a", 5000)])
    got = run(spark, path, out, cp, 20)
    late = {200, *[i for i, _, t in second if t < 1019]}
    want = plain([x for x in first + second if x[0] not in late], 20)
    assert got == want and max(Counter(i for _, i, _ in got).values()) == 1
    assert run(spark, path, out, cp, 20) == got


class Held(dict):
    """A map state, or a value, in memory; and the longest row that it has held."""

    most = 0
    containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.pop

    def updateValue(self, k, v):
        self[k] = v
        Held.most = max(Held.most, *[len(x) for x in v if isinstance(x, list)])

    def exists(self):
        return "v" in self

    def get(self):
        return self["v"]

    def update(self, v):
        self["v"] = v


class Clock:
    def __init__(self, ms=0):
        self.ms = ms

    def getMapState(self, *_):
        return Held()

    getValueState = getMapState

    def registerTimer(self, ms):
        pass

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_key_of_many_requests_is_taken_and_given_in_parts():
    """However many requests a key, or one second of it, has: rows of state and answers stay small, and no request is lost."""
    w = Window("kind", 60)
    w.init(Clock())
    rng = np.random.default_rng(1)
    at = np.concatenate((rng.integers(0, 4000, 60_000), np.full(45_000, 1234)))
    ids = np.arange(len(at))
    for i in range(0, len(at), 7000):
        list(w.handleInputRows(("a",), iter([pd.DataFrame({"second": at[i : i + 7000], "id": ids[i : i + 7000]})]), None))
    given = []
    for over in (2000, 5000):
        given += [g for g in w.handleExpiredTimer(("a",), Clock(over * 1000), None) if len(g)]
        assert sum(map(len, given)) == (at < over).sum()
    assert Held.most <= max(PART, SPAN) and max(map(len, given)) <= 2 * PART
    got = pd.concat(given).set_index("id")["n_recent"].sort_index().to_numpy()
    total = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=4001))))
    assert (got == total[at + 1] - total[np.maximum(at - 59, 0)]).all()
    assert not w.held and not w.waiting
