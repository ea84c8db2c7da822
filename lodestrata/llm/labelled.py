"""The labelled rows that classifiers learn from."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text is a multiple of 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def of_rows(labels: DataFrame, label: str) -> DataFrame:
    """(__id, label) of the labelled rows outside the held-out fold, one for each doc_id. Rows without a label or an id are not used."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return rows.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most `most` labelled rows outside the held-out fold: the smallest hashes of doc_id.

    `most` is the bound on what is broadcast here: one id and label each. Rows without a label or an id are not used.
    """
    few = of_rows(labels, label).orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id").limit(most)
    return docs.select(F.col("doc_id").alias("__d"), "text").join(F.broadcast(few), F.col("__d") == F.col("__id")).select("text", "label")
