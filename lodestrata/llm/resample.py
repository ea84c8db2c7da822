"""Operator 11: documents drawn by how much likelier their word runs are in a target than in the corpus."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import fresh, running, slices, stash, strings

#: Words of a feature at most, buckets, words of a document that may be drawn, percent drawn, seed of the noise.
RUNS, BUCKETS, LEAST, SHARE, SEED = 1, 10_000, 20, 10, 2024


def _cleaned() -> bytes:
    """A-Z in lower case; what is neither a digit nor a-z nor beyond ASCII parts words."""
    out = bytearray(range(256))
    for b in range(0x80):
        c = chr(b).lower()
        out[b] = ord(c) if "0" <= c <= "9" or "a" <= c <= "z" else 0x20
    return bytes(out)


_CLEANED = _cleaned()


def crc_ring(words: Iterable[bytes], n: int) -> Iterator[int]:
    """CRC-32 of every run of 1 to n words, joined by a space: the states of the last n starts, each extended word by word."""
    if n == 1:
        # one slot: every state is a start
        yield from map(zlib.crc32, words)
        return
    crc, state = zlib.crc32, []
    for j, word in enumerate(words):
        for i, s in enumerate(state):
            state[i] = crc(word, crc(b" ", s))
        if j < n:
            state.append(crc(word))
        else:
            # the oldest start has its n words: its slot is the newest's
            state[j % n] = crc(word)
        yield from state


def feature_buckets(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, carry: list[str] | None = None, text: str = "text") -> tuple[DataFrame, list[str]]:
    """(the columns `carry` of docs, all by default, and words, features, buckets held, count of each; those four's names).

    One scan of each whole text, one row for each row. Null and empty texts hold nothing.
    """
    carry = docs.columns if carry is None else carry
    names = fresh(docs.select(*carry), "n_words", "n_features", "buckets", "counts")
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.IntegerType(), False), T.ArrayType(T.IntegerType(), False)]
    kept = docs.select(*carry).schema.fields
    (source,) = fresh(docs, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = strings(batch.column(source))
                data = data.tobytes().translate(_CLEANED)
                n_words, hashes = [], []
                for a, b in zip(offsets, offsets[1:]):
                    words = data[a:b].split()
                    k = len(words)
                    n_words.append(k)
                    hashes.append(np.fromiter(crc_ring(words, runs), np.uint32, sum(max(0, k - i) for i in range(runs))) % np.uint32(buckets))
                sizes = [len(h) for h in hashes]
                # documents' own buckets, counted together
                row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
                key, count = np.unique(row * buckets + np.concatenate([np.zeros(0, np.uint32), *hashes]), return_counts=True)
                places = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * buckets).astype(np.int32))
                held = [pa.ListArray.from_arrays(places, pa.array(x.astype(np.int32))) for x in (key % buckets, count)]
                columns = [batch.column(f.name) for f in kept] + [pa.array(n_words, pa.int64()), pa.array(sizes, pa.int64()), *held]
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], *names])

    read = docs.select(*carry, F.col(text).alias(source))
    return read.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, k, False) for n, k in zip(names, kinds)]])), names


def totals(rows: DataFrame, at: str, counts: str, buckets: int) -> np.ndarray:
    """How many features fall in each bucket, over all rows: summed in tasks, then over them; `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            where, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (at, counts))
            np.add.at(total, where, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select(at, counts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of a key: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, least: int = LEAST, share: int = SHARE, seed: int = SEED, carry: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(every row of docs, its columns `carry` (all by default) and n_features, weight, score, rank; those four's names).

    A row's weight sums the gains of its features; with noise by doc_id that is its score, so that the `share` percent
    of highest scores among rows of `least` words are a draw without replacement in proportion to their weights. Drawn
    rows are ranked from 1; others have a null rank. Ties go to the smaller doc_id (null first), then to fewer features;
    equal rows take neighbouring ranks. Null and empty texts weigh 0 and are not drawn if `least` > 0. No rows: none;
    an empty target: weights by the corpus alone. Texts are read once: their buckets are a table that the counts and
    the weights come from. Ranks are prefix sums over ranges of narrow rows.
    """
    carry = docs.columns if carry is None else carry
    rows, (words, n, at, counts) = feature_buckets(docs, runs, buckets, carry)
    rows = stash(rows, "buckets")
    own, (_, _, t_at, t_counts) = feature_buckets(target, runs, buckets, [])
    gain = gains(totals(rows, at, counts, buckets), totals(own, t_at, t_counts, buckets))
    weight, score, rank, kept, key, row = fresh(rows, "weight", "score", "rank", "__kept", "__key", "__row")
    held = [f for f in rows.schema.fields if f.name not in (at, counts)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            sums = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)] * batch.column(counts).flatten().to_numpy(zero_copy_only=False))))
            o = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in held], pa.array(sums[o[1:]] - sums[o[:-1]], pa.int64())], names=[*[f.name for f in held], weight])

    scored = rows.mapInArrow(weigh, T.StructType([*held, T.StructField(weight, T.LongType(), False)]))
    scored = scored.withColumn(key, F.col("doc_id")).withColumn(score, F.col(weight) + noise(F.col(key), seed))
    scored = scored.withColumn(kept, F.col(words) >= least).withColumn(row, F.monotonically_increasing_id())
    drawn = rows.where(F.col(words) >= least).count() * share // 100
    order = [F.col(kept).desc(), F.col(score).desc(), F.col(key).asc_nulls_first(), F.col(n), F.col(row)]
    ranked = running(scored, order, {rank: F.lit(1)})
    ranked = ranked.withColumn(rank, F.when(F.col(kept) & (F.col(rank) < drawn), F.col(rank) + 1).cast("long"))
    return ranked.select(*carry, n, weight, score, rank), [n, weight, score, rank]


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Draws a tenth of documents by the word counts of benchmark; see resample for nulls, ties, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"), carry=["doc_id"])[0]


#: CRC-32 in SQL by its table of 256 rests, once for each distinct word.
CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of a text, where CRC_TABLE's t is in scope."""
    byte = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), (2 * k + 1)::int, 2))::bigint)"
    return f"xor(list_reduce([4294967295::bigint] || {byte}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = f"""
WITH words AS (
  SELECT 0 AS target, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
feature AS (SELECT target, id, unnest(w) AS f FROM words),
bucket AS (SELECT f, {crc_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM feature), {CRC_TABLE}),
held AS (SELECT target, id, b, count(*) AS n FROM feature JOIN bucket USING (f) GROUP BY ALL),
share AS (SELECT b, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t FROM held GROUP BY b),
every AS (SELECT b, s, t, sum(s) OVER () AS all_s, sum(t) OVER () AS all_t FROM share),
gain AS (SELECT b, floor(1000 * ln((t + 1)::double * (all_s + 10000)::double / ((s + 1)::double * (all_t + 10000)::double)))::bigint AS g FROM every),
weight AS (SELECT id, sum(n * g)::bigint AS weight FROM held JOIN gain USING (b) WHERE target = 0 GROUP BY id),
score AS (
  SELECT id AS doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score
  FROM words LEFT JOIN weight USING (id) WHERE target = 0),
place AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM score WHERE n_features >= 20)
SELECT doc_id, n_features::bigint AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM score LEFT JOIN place USING (doc_id)"""
