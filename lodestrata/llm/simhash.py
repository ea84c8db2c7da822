"""Operator 2: SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Words, by_batch, components, fresh, partitions, stash

SEED, BITS = 42, 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bits of a byte as eight byte-wide counters.
_SPREAD = np.array([sum(1 << (8 * i) for i in range(8) if b >> i & 1) for b in range(256)], np.uint64)


def fingerprints(column: pa.Array, k: int = 4) -> np.ndarray:
    """SimHash of each text of a string column (null: empty): bit i is set if over half the shingles' hashes have it."""
    import xxhash

    w = Words(column)
    # the words of a document, lower-cased, with one space after each
    lengths = w.end - w.start
    total = int(lengths.sum() + len(lengths))
    out = np.full(total, 0x20, np.uint8)
    to = np.cumsum(lengths + 1) - lengths - 1
    keep = ~w.space
    ink = np.ones(total, bool)
    ink[to + lengths] = False
    out[ink] = _LOWER[w.data[keep]]
    raw = out.tobytes()
    ends = to + lengths
    n = w.count
    shingles = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    last = np.minimum(k, n)
    doc = np.repeat(np.arange(w.docs), shingles)
    first = np.cumsum(shingles) - shingles
    at = np.arange(int(shingles.sum())) - first[doc] + w.first[:-1][doc]
    hash_of, h = xxhash.xxh64_intdigest, np.empty(len(at), np.uint64)
    for lo in range(0, len(at), 1 << 18):
        part = at[lo : lo + (1 << 18)]
        a, b = to[part].tolist(), ends[part + last[doc[lo : lo + len(part)]] - 1].tolist()
        h[lo : lo + len(part)] = np.fromiter((hash_of(raw[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
    return majority(h, shingles)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of each group's hashes; groups are consecutive."""
    result = np.zeros(len(counts), np.uint64)
    if not len(h):
        return result
    # runs of at most 255 hashes of one group, so that byte-wide counters hold
    pieces = -(-counts // 255)
    group = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(int(pieces.sum())) - (np.cumsum(pieces) - pieces)[group]
    start = (np.cumsum(counts) - counts)[group] + 255 * nth
    ones = np.zeros((len(counts), BITS), np.int64)
    some = np.flatnonzero(counts)
    first = (np.cumsum(pieces) - pieces)[some]
    view = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[view[:, byte]], start)
        lanes = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones[some, 8 * byte : 8 * byte + 8] = np.add.reduceat(lanes, first, axis=0)
    set_ = (2 * ones > counts[:, None]) & (counts > 0)[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks: whatever `radius` bits two fingerprints differ in, some mask holds none of them.

    Bit i has a vector phi(i) of radius+1 bits, not zero; mask v holds the bits with an odd <phi(i), v>. For at most
    `radius` differing bits there is a v, not zero, with <phi(i), v> even for all of them (Pagh 2016).
    """
    n = (1 << (radius + 1)) - 1
    phi = [1 + i % n for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def _roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For R runs of s fingerprints each, (R, s): the smallest number in a run that each is linked to, directly or not."""
    near = np.bitwise_count(fps[:, :, None] ^ fps[:, None, :]) <= radius
    s = fps.shape[1]
    root = np.broadcast_to(np.arange(s), fps.shape).copy()
    while True:
        new = np.where(near, root[:, None, :], s).min(axis=2)
        if (new == root).all():
            return root
        root = new


TILE = 1024
_EDGES = "kind int, a long, b long, mask int, key long"


def near_links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """fps: distinct `fp` (long) -> (a, b) links that connect every two fingerprints at `radius` or fewer bits.

    Each fingerprint goes to a bucket of each mask's table. A bucket's links are a forest, so a bucket of n
    gives fewer than n rows. Buckets of over `tile` fingerprints are dealt out again as pairs of tiles.
    """
    spark, masks = fps.sparkSession, covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    rows = fps.select("fp", tables.alias("t")).select("t.mask", "t.key", "fp")
    dealt = rows.repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key")
    names = ["kind", "a", "b", "mask", "key"]

    def batch_of(kind, a, b, mask, key):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(np.broadcast_to(mask, len(a)).astype(np.int32)), pa.array(np.broadcast_to(key, len(a)).astype(np.int64))], names=names)

    def small(fp: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Links of runs that are held whole, all of one size at once."""
        for s in np.unique(size[size > 1]).tolist():
            of = start[size == s]
            step = max(1, (1 << 21) // (s * s))
            for i in range(0, len(of), step):
                f = fp[of[i : i + step, None] + np.arange(s)]
                root = _roots(f.view(np.uint64), radius)
                at = root != np.arange(s)
                if at.any():
                    yield batch_of(0, f[at], np.take_along_axis(f, root, 1)[at], 0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the run at the end of what has been read waits for the next batch; once it is large, it is passed on in tiles
        kept = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))
        large, tiles = None, 0
        for batch in batches:
            mask, key, fp = (np.concatenate((k, c.to_numpy())) for k, c in zip(kept, batch.columns))
            first = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            if large is not None:
                n = first[1] if len(first) > 1 else len(fp)
                if (int(mask[0]), int(key[0])) != large:
                    n = 0
                whole = n if n < len(fp) else n - n % tile
                for i in range(0, whole, tile):
                    yield batch_of(1, fp[i : min(i + tile, whole)], np.full(min(tile, whole - i), tiles), *large)
                    tiles += 1
                if n < len(fp):
                    yield batch_of(2, np.array([tiles]), np.array([0]), *large)
                    large, tiles = None, 0
                mask, key, fp = mask[whole:], key[whole:], fp[whole:]
                first = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]) if len(fp) else first[:0]
                if large is not None or not len(fp):
                    kept = (mask, key, fp)
                    continue
            size = np.diff(np.r_[first, len(fp)])
            for i in np.flatnonzero(size[:-1] > tile).tolist():
                own, at = (int(mask[first[i]]), int(key[first[i]])), first[i]
                for t, j in enumerate(range(0, int(size[i]), tile)):
                    part = fp[at + j : at + min(j + tile, int(size[i]))]
                    yield batch_of(1, part, np.full(len(part), t), *own)
                yield batch_of(2, np.array([t + 1]), np.array([0]), *own)
            whole = size.copy()
            whole[-1] = 0
            whole[whole > tile] = 0
            yield from small(fp, first, whole)
            at = first[-1]
            if size[-1] > tile:
                large, tiles = (int(mask[at]), int(key[at])), 0
                n = int(size[-1]) // tile * tile
                for j in range(0, n, tile):
                    yield batch_of(1, fp[at + j : at + j + tile], np.full(tile, tiles), *large)
                    tiles += 1
                at += n
            kept = (mask[at:], key[at:], fp[at:])
        mask, key, fp = kept
        if large is not None:
            if len(fp):
                yield batch_of(1, fp, np.full(len(fp), tiles), *large)
                tiles += 1
            yield batch_of(2, np.array([tiles]), np.array([0]), *large)
        elif len(fp):
            yield from small(fp, np.array([0]), np.array([len(fp)]))

    found = stash(dealt.mapInArrow(run, _EDGES), "links")
    links = found.where("kind = 0").select("a", "b")
    if not found.where("kind = 2").take(1):
        return links
    # tile i of a large bucket meets every tile j >= i in a task of the pair (i, j): no task holds over two tiles
    sizes = found.where("kind = 2").select("mask", "key", F.col("a").cast("int").alias("tiles"))
    own = found.where("kind = 1").select("mask", "key", F.col("a").alias("fp"), F.col("b").cast("int").alias("tile"))
    meets = own.join(sizes, ["mask", "key"]).select("mask", "key", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    pairs = meets.select("mask", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "fp")

    def meet(t):
        fp = t["fp"].to_numpy()
        root = _roots(fp.view(np.uint64)[None, :], radius)[0]
        at = root != np.arange(len(fp))
        return pa.table({"a": fp[at], "b": fp[root[at]]})

    tiled = pairs.groupBy("mask", "key", "i", "j").applyInArrow(meet, "a long, b long")
    return links.unionByName(tiled)


def _grouped(docs: DataFrame, radius: int, k: int, *more: Column) -> DataFrame:
    """doc_id, `more`, fp, component (a fingerprint), component_id of every row. See simhash_groups."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    kept = [i for i, c in enumerate(texts.columns) if c != "text"]
    names = [texts.columns[i] for i in kept] + ["fp"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(fingerprints(batch.column(1), k).view(np.int64))], names=names)

    narrow = stash(by_batch(texts, run, ", ".join(f"{n} long" for n in names)), "fingerprints")
    distinct = stash(narrow.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(near_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    own = stash(distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "owned")
    smallest = own.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = own.join(smallest, "component").select("fp", "component", "component_id")
    return narrow.join(labels, "fp")


def simhash_groups(docs: DataFrame, radius: int = 4, k: int = 4) -> DataFrame:
    """doc_id, fp (long), component_id of every row: the smallest doc_id reachable by links of `radius` or fewer bits.

    Null or empty text: fingerprint zero, linked like any other. Null doc_id: kept, and never the smallest unless a
    group has no other, when component_id is null. Repeated rows stay. No rows: none.
    """
    return _grouped(docs, radius, k).select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all documents; see simhash_groups for nulls, ties, repeated rows and empty tables."""
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """docs without near copies: one row of each group stays, the smallest by (doc_id, fingerprint, text hash).

    A row without a doc_id stays only if no other of its group has one. Of rows alike in doc_id and text the smallest
    by all columns as JSON stays, so that columns that have no order, such as maps, may be there.
    """
    groups = stash(_grouped(docs, radius, 4, F.xxhash64("text").alias("th")), "groups")
    own, h, row = fresh(docs, "__id", "__h", "__row")
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "th")).alias("best"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(h))
    key = [F.col("doc_id").alias(own), F.col("th").alias(h)]
    kept = docs.join(best.select("best.*").select(*key), same, "left_semi")
    again = groups.groupBy("doc_id", "th").count().where("count > 1").select(*key)
    if not again.take(1):
        return kept
    whole = F.struct(*docs.columns)
    least = kept.join(again, same).groupBy(own, h).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*")
    return kept.join(again, same, "left_anti").unionByName(least)
