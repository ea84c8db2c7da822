"""Background work on a repository, with a status that others can ask for."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import error_text
from lodestrata.plans.upsert import recover_jobs, replace_partitions
from lodestrata.tables import create, exists, remove

SCHEMA = "status string, progress double, started_at timestamp, completed_at timestamp, error string, repo_id bigint, kind string"


def _put(spark: SparkSession, store: str, repo_id: int, kind: str, status: str, progress: float, started, completed=None, error: str | None = None) -> None:
    row = spark.createDataFrame([(status, float(progress), started, completed, error, repo_id, kind)], SCHEMA)
    replace_partitions(row, f"{store}/job", ["repo_id", "kind"])


def status(spark: SparkSession, store: str, repo_id: int, kind: str) -> dict:
    """The last job of a kind; "pending" where there was none."""
    if exists(spark, f"{store}/job"):
        found = spark.read.schema(SCHEMA).parquet(f"{store}/job").where((F.col("repo_id") == repo_id) & (F.col("kind") == kind)).first()
        if found:
            return found.asDict()
    return {"status": "pending", "progress": 0.0, "started_at": None, "completed_at": None, "error": None, "repo_id": repo_id, "kind": kind}


def _claim(store: str, repo_id: int, kind: str) -> str:
    return f"{store}/claim/{repo_id}-{kind}"


def run(spark: SparkSession, store: str, repo_id: int, kind: str, work: Callable[[Callable[[float], None]], object]) -> dict:
    """work(report) under a status: in_progress, with the share that it reports, then done, or failed with what went wrong.

    A job that is under way is not started again: the file that claims it can be made once.
    """
    claim = _claim(store, repo_id, kind)
    if not create(spark, claim):
        return status(spark, store, repo_id, kind) | {"status": "in_progress"}
    began = datetime.now(UTC)
    _put(spark, store, repo_id, kind, "in_progress", 0.0, began)
    done = [0.0]

    def report(share: float) -> None:
        done[0] = min(1.0, max(0.0, share))
        _put(spark, store, repo_id, kind, "in_progress", done[0], began)

    try:
        work(report)
        _put(spark, store, repo_id, kind, "done", 1.0, began, datetime.now(UTC))
    except Exception as e:  # noqa: BLE001  the status carries it
        _put(spark, store, repo_id, kind, "failed", done[0], began, datetime.now(UTC), error_text(type(e).__name__, str(e)))
    # a process that ends before this leaves the claim to recover()
    remove(spark, claim)
    return status(spark, store, repo_id, kind)


def recover(spark: SparkSession, store: str) -> DataFrame | None:
    """Jobs under way when the process ended have failed, and may be started again: call it at the start. Returns all jobs."""
    remove(spark, f"{store}/claim")
    if not exists(spark, f"{store}/job"):
        return None
    jobs = spark.read.schema(SCHEMA).parquet(f"{store}/job")
    rows = recover_jobs(jobs.where("status = 'in_progress'")).collect()  # a row for each repository and kind under way
    if rows:
        replace_partitions(spark.createDataFrame(rows, SCHEMA), f"{store}/job", ["repo_id", "kind"])
    return spark.read.schema(SCHEMA).parquet(f"{store}/job")
