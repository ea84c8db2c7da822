"""What the training-data operators share: scratch tables, word kernels, components."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.tables import shared_dir

#: A word, everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lodestrata-{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes not to clash with a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df and, by name, sums over all rows before each in an order without ties: ranges, then within them; no task has all rows."""
    spark, (part,) = df.sparkSession, fresh(df, "__part")
    dealt = stash(df.repartitionByRange(partitions(spark), *order).withColumn(part, F.spark_partition_id()), "ranges")
    start = Window.unboundedPreceding
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(start, -1)), F.lit(0))
    # a row for each range, of which there are as many as tasks
    parts = dealt.groupBy(part).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    parts = parts.select(F.col(part).alias("__of"), *[earlier(k, Window.orderBy(part)).alias(f"__{k}") for k in sums])
    within = Window.partitionBy(part).orderBy(*order)
    out = dealt.join(parts, F.col(part) == F.col("__of"))
    return out.select(*df.columns, *[(earlier(c, within) + F.col(f"__{k}")).alias(k) for k, c in sums.items()])


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = 4 << 20) -> DataFrame:
    """mapInArrow of a function of one batch, whose texts are cut to about `most` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                yield f(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of some `most` bytes; one row is never cut."""
    n = batch.num_rows
    if batch.nbytes <= most or n <= 1:
        if n:
            yield batch
        return
    step = max(1, n * most // batch.nbytes)
    for at in range(0, n, step):
        yield batch.slice(at, step)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of rows) of a string column; null rows are empty."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return b, o - o[0]


_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1 << 61, 1 << 63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return table(_BASE), table(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 (public domain), elementwise."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Bytes that are hashed at once: a bound on the tables of powers, however long a text is.
_BLOCK = 4 << 20


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials of spans of at most a block's bytes."""
    n = len(data)
    power, inverse = _powers(1 << max(16, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, in order and apart, from prefix sums: O(bytes + spans), no loop over spans.

    Bytes are taken a block at a time; a span of more than a block is summed piece by piece.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + _BLOCK, "right"))
        if j > i:
            out[i:j] = _sums(data[a : int(ends[j - 1])], starts[i:j] - a, ends[i:j] - a)
        else:
            total, j = 0, i + 1
            for p in range(a, int(ends[i]), _BLOCK):
                part = data[p : min(p + _BLOCK, int(ends[i]))]
                total += int(_sums(part, np.array([0]), np.array([len(part)]))[0]) * pow(_BASE, p - a, 1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words of every row of a batch, as arrays: start, end (bytes), doc (row number)."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = strings(column)
        self.docs = len(self.offsets) - 1
        self.space = _SPACE[self.data]
        ink = ~self.space
        n = len(self.data)
        first, last = ink.copy(), ink.copy()
        if n:
            inner = self.offsets[1:-1]
            before = np.empty(n, bool)
            before[0], before[1:] = False, ink[:-1]
            before[inner[inner < n]] = False
            first &= ~before
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, ink[1:]
            ends = inner[(inner > 0)] - 1
            after[ends] = False
            last &= ~after
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.docs).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte-wise array for each row."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document; and the word at which each starts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    w = np.zeros(len(at), np.uint64)
    for i in range(k):
        w = mix(w * np.uint64(0x9E3779B97F4A7C15) + h[at + i])
    return w, at


def repeated(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the key found twice or more in its doc, has it been found before in its doc)."""
    k = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = np.zeros(len(k), bool)
    same[1:] = s[1:] == s[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, later = np.empty(len(k), bool), np.empty(len(k), bool)
    out[order], later[order] = twice, same
    return out, later


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star steps (Kiveris et al. 2014): O(log n) rounds, edges never grow in
    number; a hub's edges are joined, not gathered, so that Spark may split them. Each round is a table in
    the shared folder.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    done = None
    for _ in range(60):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stash(large, "cc")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, edges = edges, stash(small, "cc")
        discard(before, large)
        total = edges.agg(F.count("*"), F.expr("coalesce(sum(hash(a, b)), 0L)"), F.count_distinct("a"), F.expr("count_if(false)")).first()
        # a star forest: every node has one parent, and no parent is a child
        if total[0] == total[2] and (total[:2] == done or not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").take(1)):
            break
        done = total[:2]
    else:
        raise RuntimeError("components did not converge in 60 rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
