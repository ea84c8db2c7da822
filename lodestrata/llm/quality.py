"""Operator 9: nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Words, by_batch, mix, repeated, span_hashes, windows
from lodestrata.llm.labelled import held_out, sample

#: Hashed features, latent dimensions, neighbours that vote, and labelled rows to learn from, at most.
FEATURES, LATENT, NEIGHBOURS, SAMPLE = 1024, 24, 15, 4000
#: Digits of a cosine that count.
DIGITS = 6
_KIND = np.full(256, 1, np.uint8)  # bytes of letters beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[:97][33:48] = 1, 2, 3, 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[[0x20, *range(9, 14)]] = 0


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h.astype(np.uint64) + np.uint64(salt * 0x9E3779B1)) % np.uint64(FEATURES - 16)).astype(np.int64) + 16


def features(column: pa.Array) -> np.ndarray:
    """(rows, FEATURES) counts of word shapes, pairs of shapes, short words and repetition; null text: none."""
    w = Words(column)
    out = np.zeros((w.docs, FEATURES), np.float32)
    n = len(w.start)
    if not n:
        return out
    kind = _KIND[w.data]
    # a shape is the word's runs of one kind of character; signs stand for themselves
    sign = np.where(kind == 4, w.data, kind)
    new = np.ones(len(sign), bool)
    new[1:] = sign[1:] != sign[:-1]
    new[w.start] = True
    at = np.flatnonzero(new)
    runs, pos = np.ascontiguousarray(sign[at]), np.cumsum(new)
    shape = span_hashes(runs, pos[w.start] - 1, pos[w.end - 1])
    h = w.hashes()
    length = np.minimum(w.end - w.start, 24)

    def add(doc, feature, weight=1.0):
        out.ravel()[:] += np.bincount(doc * FEATURES + feature, minlength=out.size).astype(np.float32) * weight

    add(w.doc, _bucket(shape, 1))
    pair, first = windows(shape, w.doc, 2)
    add(w.doc[first], _bucket(pair, 2))
    add(w.doc, _bucket(length // 3, 3))
    short = np.flatnonzero(length <= 4)
    add(w.doc[short], _bucket(h[short], 4), 0.3)
    # reserved places: repetition
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    add(w.doc[same], np.zeros(int(same.sum()), np.int64), 3.0)
    tri, where = windows(h, w.doc, 3)
    if len(tri):
        twice, _ = repeated(tri, w.doc[where])
        add(w.doc[where[twice]], np.ones(int(twice.sum()), np.int64), 3.0)
    counts = w.count.astype(np.int64)
    some = counts > 0
    out[np.arange(w.docs)[some], 2 + np.minimum(np.log2(counts[some]).astype(int), 13)] = np.sqrt(counts[some])
    return out


@dataclass
class Neighbours:
    """Labelled unit vectors in latent space, and the projection of features to it: bounded by SAMPLE and FEATURES."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    idf: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        x = np.sqrt(x) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors, drawn a little to the share of all.

        Cosines are rounded to DIGITS; of those that tie at the cut the lower numbers vote, so that no score depends on the block.
        """
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(x), prior)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for at in range(0, len(x), block):
            cos = np.round(self.latent(x[at : at + block]).astype(np.float64) @ self.vectors.T.astype(np.float64), DIGITS)
            cut = np.partition(cos, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            # all above the cut, and the first of those at it
            above, level = cos > cut, cos == cut
            voters = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            top = np.nonzero(voters)[1].reshape(len(cos), k)
            weight = np.maximum(np.take_along_axis(cos, top, 1), 0.0) ** 8
            vote = (weight * self.labels[top]).sum(axis=1)
            got = (vote + 0.05 * prior) / (weight.sum(axis=1) + 0.05)
            out[at : at + block] = np.where(x[at : at + block].any(axis=1), got, prior)
        return np.clip(out, 0.0, 1.0)


def fit(x: np.ndarray, labels: np.ndarray) -> Neighbours:
    """Latent-semantic axes by the eigenvectors of the features' second moments; an empty sample scores 0.5."""
    df = (x > 0).sum(axis=0)
    idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
    model = Neighbours(np.zeros((FEATURES, LATENT), np.float32), np.zeros((0, LATENT), np.float32), labels.astype(np.float64), idf)
    if len(x):
        y = np.sqrt(x) * idf
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        _, axes = np.linalg.eigh(y.T @ y)
        model.project = np.ascontiguousarray(axes[:, ::-1][:, :LATENT]).astype(np.float32)
        model.vectors = model.latent(x)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Neighbours:
    """Fit on at most `most` labelled rows outside the held-out fold: a bound on what reaches the driver and is broadcast."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(0))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    rows = sorted((bytes(r[1]), int(r[0])) for r in by_batch(sample(docs, labels, "quality", most), run, "label int, x binary").collect())
    x = np.stack([np.frombuffer(r[0], np.float32) for r in rows]) if rows else np.zeros((0, FEATURES), np.float32)
    return fit(x, np.array([r[1] for r in rows], np.float64))


def score_quality(docs: DataFrame, model: Neighbours, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null or empty text: the labelled rows' mean. Rows are not moved.

    Repeated rows stay and score alike; neighbours that tie are taken by number; other columns are not read. No rows: none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(features(batch.column(2)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; see score_quality. A label of a document that isn't there is not used; no labels: every score is 0.5."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, train(docs, labels))
