"""Incremental history: pages -> idempotent upserts, one checkpointed offset a page."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lodestrata.plans.store import Store
from lodestrata.plans.upsert import KEYS
from lodestrata.sources import history

ROWS = {"commits": ("commit", history.commits), "pull_requests": ("pull_request", history.pull_requests), "issues": ("issue", history.issues)}
#: The column of a table's own ids, made from its key, so that a replay gives the same.
IDS = {"commit": "commit_id", "pull_request": "pr_id", "issue": "issue_id"}


#: The stages' states are kept under the repository's number.
STAGES = tuple(ROWS)


class Progress(StreamingQueryListener):
    """Passes a stage's progress on: report(stage, batch, rows) after each batch of the stream of its name."""

    def __init__(self, report: Callable[[str, int, int], None]) -> None:
        self.report = report

    def onQueryStarted(self, event) -> None:
        """Nothing is done yet."""

    def onQueryProgress(self, event) -> None:
        if event.progress.name in STAGES:
            self.report(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryTerminated(self, event) -> None:
        """The stage's state says how it ended."""


def ingest_stage(store: Store, source: dict, stage: str, repo_id: int, checkpoint: str, since: str | None = None) -> dict:
    """Take what pages of a stage a source has and that aren't taken yet, comments and review bodies too; returns the stage's state.

    source: options of a stream format of pages, "format" among them. A page's rows, its cursor and the count so far are one
    commit of the store, so a page given again changes nothing, wherever it broke off. Tables' buckets are written at the end.
    """
    spark, table, rows = store.spark, *ROWS[stage]
    history.register(spark)
    name = f"{repo_id}/{stage}"

    def take(batch: DataFrame, batch_id: int) -> None:
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        batch = batch.persist()
        try:
            nodes = history.nodes_of(batch.withColumn("repo_id", F.lit(repo_id).cast("long")), stage)
            if since is not None and stage != "commits":
                nodes = history.within(nodes, F.lit(since).cast("timestamp"))
            updated = F.col("node.updatedAt").try_cast("timestamp").alias("__updated")
            new = rows(nodes.withColumn("__updated", updated), "__updated").withColumn(IDS[table], F.xxhash64(F.lit(table), *KEYS[table]))
            found = {table: new}
            if stage != "commits":
                said = history.comments(nodes)
                if stage == "pull_requests":
                    said = said.unionByName(history.comments(nodes, reviews=True))
                found["comment"] = said.withColumn("__updated", F.lit(None).cast("timestamp"))
            last = batch.agg(F.max("number")).first()[0]
            store.append(name, run, batch_id, found, {"page": last, "count": nodes.count(), "done": False, "error": None})
        finally:
            batch.unpersist()

    stream = spark.readStream.format(source["format"]).options(**{k: v for k, v in source.items() if k != "format"}, stage=stage).load()
    try:
        q = stream.writeStream.queryName(stage).foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{stage}").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        store.compact(table)
        store.compact("comment")
    except Exception as e:  # noqa: BLE001  the state carries it
        return store.set_state(name, done=False, error=f"{type(e).__name__}: {e}"[:500])
    return store.set_state(name, done=True, error=None)


def ingest_history(spark: SparkSession, source: dict | str, repo_id: int, path: str, checkpoint: str, since: str | None = None, months: int = 12,
    again: bool = False, report: Callable[[str, int, int], None] | None = None, now: datetime | None = None) -> dict:
    """Commits, pull requests, issues into a store; returns the states of the stages and in all.

    The store keeps the window, page, count and end of each stage, so that a later call goes on where this one broke off, in
    the same window, and reads no stage that is done; again: it looks for new pages. since: an ISO time; None: `months` of 30
    days before now. source: options of a stream format, or the folder of stored pages.
    """
    source = {"format": "pages", "path": source} if isinstance(source, str) else source
    store = Store(spark, path)
    held, window = store.state(), f"{repo_id}/window"
    since = since or held.get(window, {}).get("since") or ((now or datetime.now(UTC)) - timedelta(days=30 * months)).isoformat()
    if held.get(window, {}).get("since") != since:
        store.set_state(window, since=since)
    listener = Progress(report) if report else None
    if listener:
        spark.streams.addListener(listener)
    state, status = {}, "done"
    try:
        for stage in STAGES:
            name = f"{repo_id}/{stage}"
            if held.get(name, {}).get("done") and not again:
                state[stage] = held[name]
                continue
            state[stage] = ingest_stage(store, source, stage, repo_id, checkpoint, since)
            if not state[stage]["done"]:
                status = "failed"
                break
    finally:
        if listener:
            spark.streams.removeListener(listener)
    store.clean()
    return state | {"status": status, "since": since}


def requests_in_window(events: DataFrame, key: str, seconds: int = 60, bucket: int = 3600) -> DataFrame:
    """events + n_recent: rows of the same key in the `seconds` up to each.

    A key's rows are parted by `bucket` seconds, so that a busy key is no single task's; a bucket also sees the last `seconds` of the one before.
    """
    from pyspark.sql import Window

    at, of, guest = (f"__{x}" for x in ("at", "bucket", "guest"))
    rows = events.withColumn(at, F.unix_timestamp("ts"))
    own = F.floor(F.col(at) / bucket)
    late = F.pmod(F.col(at), F.lit(bucket)) > bucket - seconds
    here = F.struct(own.alias(of), F.lit(False).alias(guest))
    both = F.when(late, F.array(here, F.struct((own + 1).alias(of), F.lit(True).alias(guest)))).otherwise(F.array(here))
    dealt = rows.withColumn(of, F.explode(both)).withColumn(guest, F.col(f"{of}.{guest}")).withColumn(of, F.col(f"{of}.{of}"))
    w = Window.partitionBy(key, of).orderBy(at).rangeBetween(-(seconds - 1), 0)
    return dealt.withColumn("n_recent", F.count("*").over(w)).where(~F.col(guest)).drop(at, of, guest)
