"""An approximate index over embeddings: random projections of unit vectors. Exact search is the default; this is for tables where a scan is too slow."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.vectors import l2_normalize, norm
from lodestrata.operators.search import KEYS, of_types


def build_index(embeddings: DataFrame, bucket: float = 1.0, tables: int = 8, seed: int = 7) -> tuple[BucketedRandomProjectionLSHModel, DataFrame]:
    """(model, every embedding with its buckets), to be written beside the table. Zero vectors are left out, as in exact search."""
    unit = embeddings.where(norm(F.col("embedding")) > 0).select(*KEYS, array_to_vector(l2_normalize(F.col("embedding"))).alias("unit"))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="buckets", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    return model, model.transform(unit)


def indexed_topk(model: BucketedRandomProjectionLSHModel, indexed: DataFrame, query, k: int, types: set[str] | None = None) -> DataFrame:
    """As vector_topk, among what shares a bucket with the query: between unit vectors at distance d the cosine is 1 - d^2 / 2.

    Filters come before the index, so that k is honoured where enough rows are near.
    """
    q = np.asarray(query, float)
    near = model.approxNearestNeighbors(of_types(indexed, types), Vectors.dense(q / np.linalg.norm(q)), k, "d")
    return near.select(*KEYS, (1 - F.col("d") * F.col("d") / 2).alias("score")).withColumn("distance", 1 - F.col("score"))
