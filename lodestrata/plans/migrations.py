"""Steps from one shape of a store's tables to the next and back, and a log of those taken."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.schemas import META, conform
from lodestrata.tables import create, exists, file_system, names, remove

Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """A rewrite of one table, maybe under another name. up and down leave a table as it is that has been rewritten before."""

    number: int
    what: str
    before: str
    after: str
    up: Change
    down: Change
    partitions: tuple[str, ...] = ("repo_id",)
    partitions_before: tuple[str, ...] = ("repo_id",)


def _with(name: str, kind: str, value: str = "null") -> Change:
    return lambda df: df if name in df.columns else df.withColumn(name, F.expr(f"cast({value} as {kind})"))


def _without(*columns: str) -> Change:
    return lambda df: df.drop(*columns)


def _any_entity(df: DataFrame) -> DataFrame:
    if "entity_id" in df.columns:
        return df
    named = df.withColumnRenamed("chunk_id", "entity_id").withColumn("entity_type", F.lit("chunk"))
    return named.withColumn("dimension", F.size("embedding"))


def _chunks_alone(df: DataFrame) -> DataFrame:
    """Embeddings of other entities have no place in the older table, and go."""
    if "chunk_id" in df.columns:
        return df
    return df.where("entity_type = 'chunk'").withColumnRenamed("entity_id", "chunk_id").drop("entity_type", "dimension")


STEPS = (
    Step(1, "the commit that a repository was read at", "repo", "repo", _with("commit_sha", "string"), _without("commit_sha")),
    Step(2, "embeddings of any entity in place of those of chunks", "chunk_embedding", "embedding", _any_entity, _chunks_alone, ("repo_id", "entity_type")),
    Step(3, "when a commit was committed, beside when it was written", "commit", "commit", _with("committed_at", "timestamp", "authored_at"), _without("committed_at")),
    Step(4, "what a chunk's syntax tells of it", "chunk", "chunk", lambda df: _with("extra_metadata", META)(_with("is_async", "boolean", "false")(df)), _without("is_async", "extra_metadata")),
)


def log(spark: SparkSession, store: str) -> list[tuple[int, str]]:
    """(step, "up" or "down") in the order in which they were taken."""
    taken = [x.split("-") for x in names(spark, f"{store}/migrations")]
    return [(int(n), way) for _, n, way in sorted(taken)]


def version(spark: SparkSession, store: str) -> int:
    """The last step whose shape the store has."""
    taken = log(spark, store)
    if not taken:
        return 0
    n, way = taken[-1]
    return n if way == "up" else n - 1


def _note(spark: SparkSession, store: str, number: int, way: str) -> None:
    if not create(spark, f"{store}/migrations/{len(log(spark, store)):06d}-{number}-{way}"):
        raise RuntimeError(f"another session is migrating {store}")


def _rewrite(spark: SparkSession, store: str, source: str, target: str, change: Change, partitions: tuple[str, ...]) -> None:
    """The table `source`, changed, as the table `target`: written beside it and renamed, so that it is whole at any time or there as it was."""
    here = lambda name: f"{store}/{name}"
    if not exists(spark, here(source)):
        # not there, or renamed before a crash
        return
    if source != target and exists(spark, here(target)):
        # whole, by a rename before a crash
        remove(spark, here(source))
        return
    part, old = f"{source}--{uuid.uuid4().hex}", f"{source}--old-{uuid.uuid4().hex}"
    change(spark.read.parquet(here(source))).write.partitionBy(*partitions).parquet(here(part))
    move = lambda a, b: file_system(spark, here(a))[0].rename(file_system(spark, here(a))[1], file_system(spark, here(b))[1])
    if source == target:
        move(source, old)
        move(part, target)
        remove(spark, here(old))
    else:
        move(part, target)
        remove(spark, here(source))


def mend(spark: SparkSession, store: str) -> None:
    """After a crash between the two renames of a rewrite: put the table back, and remove what is half done."""
    for x in names(spark, store):
        if "--old-" in x and not exists(spark, f"{store}/{x.split('--')[0]}"):
            fs, path = file_system(spark, f"{store}/{x}")
            fs.rename(path, file_system(spark, f"{store}/{x.split('--')[0]}")[1])
        elif "--" in x:
            remove(spark, f"{store}/{x}")


def migrate(spark: SparkSession, store: str, to: int | None = None, steps: tuple[Step, ...] = STEPS) -> list[tuple[int, str]]:
    """Take the steps that lie between the store's shape and `to` (the newest by default), up or down; returns those taken.

    A step is logged after its rewrite; one that broke off is taken again and finds its table rewritten or not.
    """
    to = steps[-1].number if to is None else to
    mend(spark, store)
    at, taken = version(spark, store), []
    way = [(s, "up") for s in steps if at < s.number <= to] if to >= at else [(s, "down") for s in reversed(steps) if to < s.number <= at]
    for step, direction in way:
        if direction == "up":
            _rewrite(spark, store, step.before, step.after, step.up, step.partitions)
        else:
            _rewrite(spark, store, step.after, step.before, step.down, step.partitions_before)
        _note(spark, store, step.number, direction)
        taken.append((step.number, direction))
    return taken


def read(spark: SparkSession, store: str, table: str, steps: tuple[Step, ...] = STEPS) -> DataFrame:
    """A table in the newest shape, whatever the store's: the steps that it lacks are part of the plan, and nothing is written."""
    at, name = version(spark, store), table
    chain = [s for s in steps if s.number > at]
    for step in reversed(chain):
        name = step.before if step.after == name and not exists(spark, f"{store}/{name}") else name
    df = spark.read.parquet(f"{store}/{name}")
    for step in chain:
        if step.after == table:
            df = step.up(df)
    return conform(df, table)
