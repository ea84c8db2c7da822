"""Listings and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graph import EDGE_TYPES
from lodestrata.tables import stash


def filtered(chunks: DataFrame, **equal) -> DataFrame:
    """AND of equalities; None and "" are no filter."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[1] not in (None, "") else df, equal.items(), chunks)


def chunk_page(chunks: DataFrame, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset 0 or more")
    return filtered(chunks, **equal).orderBy("file_id", "start_line", "chunk_id").offset(offset).limit(limit)


def chunk_summary(chunks: DataFrame, **equal) -> DataFrame:
    """Counts by type, by language and in all, in one pass."""
    rows = filtered(chunks, **equal).groupingSets([["chunk_type"], ["language"], []], "chunk_type", "language").agg(F.count("*").alias("n"), F.grouping("chunk_type").alias("gt"), F.grouping("language").alias("gl"))
    by = F.when((F.col("gt") == 1) & (F.col("gl") == 1), "total").when(F.col("gt") == 0, "chunk_type").otherwise("language")
    return rows.select(by.alias("by"), F.when(F.col("gt") == 0, F.col("chunk_type")).when(F.col("gl") == 0, F.col("language")).alias("value"), "n")


def file_chunk_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"))
    return files.join(counts, "file_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))


def entity_counts(entities: DataFrame, embeddings: DataFrame, types: list[str]) -> DataFrame:
    """total and embedded by entity type, 0 where there is none."""
    tagged = entities.select("entity_type", F.lit(0).alias("e")).unionByName(embeddings.select("entity_type", F.lit(1).alias("e")))
    got = tagged.groupBy("entity_type").agg(F.sum(1 - F.col("e")).alias("total"), F.sum("e").alias("embedded"))
    return _all_of(got, types, "entity_type", ["total", "embedded"])


def edge_counts(edges: DataFrame) -> DataFrame:
    return _all_of(edges.groupBy("edge_type").agg(F.count("*").alias("n")), EDGE_TYPES, "edge_type", ["n"])


def _all_of(counts: DataFrame, values: list[str], key: str, columns: list[str]) -> DataFrame:
    table = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return table.join(counts, key, "left").select(key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns])


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next rows by key: a filter that a scan can push down, and a top-k."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def lookup(df: DataFrame, **key) -> DataFrame:
    """The row of a key: equalities that a scan pushes down. No row where there is none."""
    return reduce(lambda out, kv: out.where(F.col(kv[0]) == kv[1]), key.items(), df).limit(1)


def file_list(files: DataFrame, chunks: DataFrame, repo_id: int | None = None) -> DataFrame:
    """Files in order of path, with their numbers of chunks."""
    own = files if repo_id is None else files.where(F.col("repo_id") == repo_id)
    return file_chunk_counts(own, chunks).orderBy("path")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows and `nth`, from 1 in order of a key without ties: numbers within ranges, and the rows of the ranges before."""
    dealt = stash(rows.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id()), "ranges")
    # a row for each range
    parts = dealt.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return dealt.join(parts.select("__part", before.alias("__before")), "__part").withColumn("nth", (F.col("__before") + within).cast("int")).drop("__part", "__before")
