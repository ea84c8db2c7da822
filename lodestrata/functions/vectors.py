"""Vector functions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return _dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def l2_normalize(v: Column) -> Column:
    """Each component over the norm; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def hash_vector(text: str | None, dim: int) -> np.ndarray:
    """Bag of words: a token counts at md5(token) mod dim; then unit length. A text without a token is the first axis."""
    v = np.zeros(dim)
    for w in re.findall(r"\w+", (text or "").lower()):
        v[int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1.0  # noqa: S324  not for secrecy
    if not v.any():
        v[0] = 1.0
    return v / np.linalg.norm(v)


def hash_embed(text: Column, dim: int = 384) -> Column:
    """hash_vector over Arrow batches: 128-bit remainders have no built-in, and a lambda over dim slots is far slower."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t, dim))

    return embed(text)
