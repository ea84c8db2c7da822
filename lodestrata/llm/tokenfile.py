"""Operator 1: token ids in directly addressable codes.

File format DAC1 (little-endian), one file per range of documents:

    8 bytes  magic b"LSDAC1\\0\\0"
    4 int64  number of documents D, of ids N, of levels L, bits of a chunk (8)
    D int64  doc_id; D bytes: 1 if doc_id is null
    D+1 int64  first id of each document, and N
    for each level: int64 n (chunks), int64 w (64-bit words), w uint64 continuation bitmap,
                    w+1 uint32 rank directory (ones before each word, modulo 2^32 not reached: N < 2^31),
                    n bytes chunks; every part is padded to 8 bytes

Id i is read chunk by chunk: the chunk at level 0 is at i; where its continuation bit is set, the chunk of the
next level is at rank(i). One id costs L constant-time steps and no block is decoded.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import fresh, new_path, partitions, slices
from lodestrata.llm.tokenizing import tokenizer_path, tokens

MAGIC, BITS = b"LSDAC1\0\0", 8
END_ID = 2
#: Bytes of text that are encoded at once, and ids that are read back at once.
TEXT_BYTES, READ_IDS = 4 << 20, 1 << 20


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def encode_dac(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes from the ids of its documents."""
    out = io.BytesIO()
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= (1 << BITS)
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        rest = rest[more] >> BITS
        if not len(rest):
            break
    out.write(MAGIC + np.array([len(doc_ids), len(ids), len(levels), BITS], "<i8").tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(_padded(np.array([d is None for d in doc_ids], np.uint8).tobytes()))
    out.write(np.concatenate(([0], np.cumsum(lengths))).astype("<i8").tobytes())
    for chunks, more in levels:
        bitmap = np.packbits(more, bitorder="little").tobytes()
        bitmap += b"\0" * (-len(bitmap) % 8)
        words = np.frombuffer(bitmap, "<u8")
        rank = np.concatenate(([0], np.cumsum(np.bitwise_count(words)))).astype("<u4")
        out.write(np.array([len(chunks), len(words)], "<i8").tobytes() + bitmap + _padded(rank.tobytes()) + _padded(chunks.tobytes()))
    return out.getvalue()


class DacFile:
    """A reader over any buffer (bytes, mmap): ids by number, by slice, by document."""

    def __init__(self, raw) -> None:
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a DAC1 file")
        self.raw = raw
        d, self.n, levels, bits = (int(x) for x in np.frombuffer(raw, "<i8", 4, 8))
        if bits != BITS:
            raise ValueError(f"chunks of {bits} bits")
        at = 40
        ids = np.frombuffer(raw, "<i8", d, at)
        at += 8 * d
        null = np.frombuffer(raw, np.uint8, d, at)
        at += d + -d % 8
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.starts = np.frombuffer(raw, "<i8", d + 1, at)
        at += 8 * (d + 1)
        self.levels = []
        for _ in range(levels):
            n, w = (int(x) for x in np.frombuffer(raw, "<i8", 2, at))
            at += 16
            bitmap = np.frombuffer(raw, "<u8", w, at)
            at += 8 * w
            rank = np.frombuffer(raw, "<u4", w + 1, at)
            at += 4 * (w + 1) + -4 * (w + 1) % 8
            self.levels.append((np.frombuffer(raw, np.uint8, n, at), bitmap, rank))
            at += n + -n % 8

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, rank in self.levels:
            value |= int(chunks[i]) << shift
            word, bit = divmod(i, 64)
            held = int(bitmap[word])
            if not held >> bit & 1:
                break
            i = int(rank[word]) + (held & ((1 << bit) - 1)).bit_count()
            shift += BITS
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b, level by level; only the chunks in question are touched."""
        value, at, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for chunks, bitmap, rank in self.levels:
            if b <= a:
                break
            value[at] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            w0, w1 = a // 64, -(-b // 64)
            more = np.unpackbits(bitmap[w0:w1].view(np.uint8), bitorder="little")[a - 64 * w0 : b - 64 * w0].astype(bool)
            before = int(rank[w0]) + (int(bitmap[w0]) & ((1 << (a % 64)) - 1)).bit_count()
            at = at[more]
            a, b, shift = before, before + len(at), shift + BITS
        return value

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, most: int = READ_IDS) -> Iterator[np.ndarray]:
        """Ids of each document in turn; those of several are read at once, `most` or a document's."""
        k, last = 0, len(self.starts) - 1
        while k < last:
            to = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + most, "right")) - 1)
            ids = self.slice(int(self.starts[k]), int(self.starts[to]))
            yield from np.split(ids, (self.starts[k + 1 : to] - self.starts[k]))
            k = to


def _write(path: str, raw: bytes) -> None:
    """One atomic put, to any store that pyarrow opens."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner) as out:
        out.write(raw)


def write_token_files(docs: DataFrame, to: str, tokenizer: str | None = None, end_id: int | None = END_ID, file_ids: int = 4 << 20) -> DataFrame:
    """Encode whole texts and write them to DAC1 files in ascending doc_id order; returns the manifest.

    Manifest: file, part, seq, docs, ids, start (ids before the file's first). Documents are range-partitioned by
    doc_id, nulls first, equal ids by the text's hash, and each task writes its own range, a file for every `file_ids` ids.
    A file that a lost or repeated attempt wrote is not in the manifest, which is committed by Spark. Null text:
    empty; no rows: an empty manifest; other columns are not read.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    manifest = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, t = TaskContext.get().partitionId(), 0, tokens(tokenizer)
        keys, lengths, held, size = [], [], [], 0

        def flush():
            nonlocal keys, lengths, held, size, seq
            ids = np.concatenate(held)
            name = f"{to}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex[:12]}.dac"
            _write(name, encode_dac(keys, np.concatenate(lengths), ids))
            row = pa.RecordBatch.from_pylist([{"file": name, "part": part, "seq": seq, "docs": len(keys), "ids": len(ids)}], manifest)
            keys, lengths, held, size, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for piece in slices(batch, TEXT_BYTES):
                ids, before = t.encode(piece.column(1), end_id)
                keys += piece.column(0).to_pylist()
                lengths.append(np.diff(before))
                held.append(ids)
                size += len(ids)
                if size >= file_ids:
                    yield flush()
        if keys:
            yield flush()

    # the row's number parts rows that are alike in id and text, which may be many
    salt, h = fresh(docs, "__salt", "__h")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias(h), F.monotonically_increasing_id().alias(salt))
    order = [F.col("doc_id").asc_nulls_first(), h, salt]
    ordered = ordered.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = ordered.mapInArrow(run, "file string, part int, seq int, docs long, ids long")
    rows.write.parquet(f"{to}/manifest")
    table = spark.read.parquet(f"{to}/manifest")
    # ids before a file: those of the parts before, a row each, and those of its own part
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = table.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", earlier(Window.orderBy("part")).alias("before"))
    return table.join(parts, "part").withColumn("start", F.col("before") + earlier(Window.partitionBy("part").orderBy("seq"))).drop("before")


def read_token_files(manifest: DataFrame, to: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file of every document in the files of a manifest."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(to)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    listed = files.select(name(F.col("path")).alias("name"), "content").join(manifest.select(name(F.col("file")).alias("name"), F.col("start").alias("base")), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                f = DacFile(batch.column(1)[k].as_buffer())
                base = batch.column(2)[k].as_py()
                crc = [zlib.crc32(np.ascontiguousarray(ids)) for ids in f.documents()]
                name = pa.array([batch.column(0)[k].as_py()] * len(crc), pa.string())
                arrays = [pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1] + base), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64()), name]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    return listed.select("name", "content", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, through files, back to a row per document."""
    to = new_path(spark, "tokens")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), to)
    return read_token_files(manifest, to)
