"""Operator 5: sum-of-squares packing of documents into sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import by_batch, slices, stash
from lodestrata.llm.tokenizing import tokenizer_path, tokens

END_ID = 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every whole text; only longer documents are cut.

    Null or empty text: one piece of the end id alone. Repeated rows: repeated pieces.
    """
    tokenizer = tokenizer or tokenizer_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, before = tokens(tokenizer).encode(batch.column(1), end_id)
        n = np.diff(before)
        pieces = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(n[doc] - start, capacity)
        raw = np.ascontiguousarray(ids, "<u4").view(np.uint8)
        cuts = 4 * np.append(before[doc] + start, len(ids))
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        arrays = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        if with_ids:
            arrays.append(pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)]))
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECE + ", ids binary" * with_ids)


class Bins:
    """Items go, in the order given, where the sum over gaps of (open bins with that gap)^2 gets smallest.

    A bin that is full is closed and no longer counted. Ties go to the smallest gap, then to the oldest bin.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bin of each further item, and what the bin held before it."""
        capacity, count, bins = self.capacity, self.count, self.bins
        out, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for k, s in enumerate(sizes.tolist()):
            # gap g becomes g - s: the sum changes by 2 (count[g - s] - count[g]) + 2, without the new gap's share at 0
            change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
            change[0] = 1 - 2 * count[s]
            change[count[s:] == 0] = np.iinfo(np.int64).max
            fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
            best = int(change.argmin())
            if change[best] <= fresh:
                g = best + s
                b = heapq.heappop(bins[g])
                count[g] -= 1
            else:
                b, g, self.n = self.n, capacity, self.n + 1
            out[k], offset[k] = b, capacity - g
            if g > s:
                count[g - s] += 1
                heapq.heappush(bins[g - s], b)
        return out, offset


def pack(pieces: DataFrame, capacity: int = 4096, shard: int = 24_000) -> DataFrame:
    """pieces + sequence_id, offset: every piece whole in one sequence, gapless from 0.

    Pieces are dealt out evenly to shards of about `shard` pieces, a task each, and each is packed largest first; what a shard leaves
    open is a few sequences, so the loss is under a thousandth. Sequences never span shards, so no step needs
    all pieces in one task; a task holds its open sequences' gaps and some 4 MB of pieces, with their ids or without.
    """
    pieces = stash(pieces, "pieces", "zstd")
    names, shards = pieces.columns, max(1, round(pieces.count() / shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = Bins(capacity), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                own, offset = bins.add(part.column("length").to_numpy())
                columns = {n: part.column(n) for n in names}
                yield pa.RecordBatch.from_pydict({**columns, "sequence_id": pa.array(own + base), "offset": pa.array(offset)})

    # dealt out in turn, after a sort within each task that makes a repeated attempt the same: alike pieces go to all shards
    dealt = pieces.repartition(shards).sortWithinPartitions(F.desc("length"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_tokens(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """The packed pieces of every text with their ids; ids_crc32 is that of the ids as packed."""
    return pack(tokenize_pieces(docs, capacity, with_ids=True), capacity).withColumn("ids_crc32", F.crc32("ids"))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all documents; see tokenize_pieces and pack. A null text is an empty one, equal rows are packed each, ties go by doc_id; no rows: none."""
    return pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
