"""Upserts without MERGE: a new version of a table from the old one and a batch; and tables by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The columns that a later version of a row replaces.
UPDATED = {
    "commit": ["author_name", "author_email", "authored_at", "committed_at", "message", "parent_shas", "files_changed_count", "additions", "deletions"],
    "pull_request": ["title", "body", "state", "merged_at", "closed_at", "merge_commit_sha", "files_changed_count", "additions", "deletions"],
    "issue": ["title", "body", "state", "closed_at", "labels"],
    "comment": ["body"],
}
KEYS = {"commit": ["repo_id", "sha"], "pull_request": ["repo_id", "number"], "issue": ["repo_id", "number"], "comment": ["repo_id", "number", "github_id"]}


def latest(batch: DataFrame, keys: list[str], order) -> DataFrame:
    """The last row of each key."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("__n", number).where("__n = 1").drop("__n")


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], updated: list[str], order=None) -> DataFrame:
    """old with batch: new keys are added; of known ones only the `updated` columns change.

    One full outer join on the key; what both sides don't share stays as it is. A batch that names a key twice counts
    its last row by `order` (default: the whole row, descending), so a replay gives the same table.
    """
    last = latest(batch, keys, order if order is not None else [F.desc(F.to_json(F.struct(*sorted(batch.columns))))])
    o, b = old.alias("o"), last.withColumn("__new", F.lit(True)).alias("b")
    both = o.withColumn("__old", F.lit(True)).alias("o").join(b, keys, "full")
    pick = lambda c: F.when(F.col("__new") & (F.lit(c in updated) | F.col("__old").isNull()), F.col(f"b.{c}") if c in batch.columns else F.lit(None)).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*[F.col(c) if c in keys else pick(c) for c in old.columns])


def upsert_table(old: DataFrame, batch: DataFrame, table: str, order=None) -> DataFrame:
    return upsert(old, batch, KEYS[table], UPDATED[table], order)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and of new the keys that old has not: a real row is never overwritten."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that df has rows for; a batch without rows deletes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """What was under way when the process ended has failed."""
    return jobs.withColumn("status", F.when(F.col("status") == "in_progress", "failed").otherwise(F.col("status")))
