"""Operator 10: quality rules and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Words, by_batch, mix, repeated, running, slices, span_hashes, stash, windows
from lodestrata.llm.labelled import held_out, of_rows

#: Hash buckets of 1- and 2-grams (fixed, so the model is 80 KB whatever the corpus), and additive smoothing.
BUCKETS, SMOOTH = 10_000, 1.0
#: A good text lost counts for so many poor ones kept.
DEAR = 10
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def counts(w: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text, from its words and their hashes; null: zeros."""
    chars = w.per_doc(~w.space & ((w.data & 0xC0) != 0x80))
    symbols = w.per_doc(_SYMBOL[w.data])
    # lines, as byte spans; those with a word are compared within their document
    cut = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate((w.offsets[:-1], cut + 1)))
    doc_of = np.searchsorted(w.offsets[1:], start, "right")
    ok = start < len(w.data)
    end = np.append(start[1:], len(w.data))
    newline = np.zeros(len(end), bool)
    inside = end > start
    newline[inside] = w.data[end[inside] - 1] == 10
    end = end - newline
    # a row's last line ends where the next row starts, and has no newline of its own to lose
    ink = np.concatenate(([0], np.cumsum(~w.space)))
    full = ok & (ink[end] > ink[np.minimum(start, len(w.data))])
    s, e, d = start[full], end[full], doc_of[full]
    _, later = repeated(span_hashes(w.data, s, e), d) if len(s) else (None, np.zeros(0, bool))
    dup = np.bincount(d[later], minlength=w.docs)
    tri, at = windows(h, w.doc, 3)
    cover = np.zeros(len(w.start), bool)
    if len(tri):
        twice, _ = repeated(tri, w.doc[at])
        for i in range(3):
            cover[at[twice] + i] = True
    again = np.bincount(w.doc[cover], minlength=w.docs)
    return {"n_words": w.count, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup.astype(np.int64), "n_repeat_words": again.astype(np.int64)}


def grams(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every hashed 1- and 2-gram of words."""
    pair, at = windows(h, w.doc, 2)
    bucket = np.concatenate((h % np.uint64(BUCKETS), mix(pair) % np.uint64(BUCKETS))).astype(np.int64)
    return bucket, np.concatenate((w.doc, w.doc[at]))


def multinomial(docs: DataFrame) -> np.ndarray:
    """Counts of all rows' n-grams by bucket. Each task sends BUCKETS numbers; what reaches the driver is as much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(0))
                total += np.bincount(grams(w, w.hashes())[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out


def ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | raw), smoothed; zeros without a trusted text."""
    if not trusted.sum():
        return np.zeros(BUCKETS)
    p, q = ((x + SMOOTH) / (x + SMOOTH).sum() for x in (trusted, raw))
    return np.log(p) - np.log(q)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of all rows labelled as good, outside the held-out fold. Texts are shuffled by id, and hashed against the ids of each part."""
    good = of_rows(labels.where("quality = 1"), "quality").hint("shuffle_hash")
    return docs.select(F.col("doc_id").alias("__d"), "text").where(~held_out("__d")).join(good, F.col("__d") == F.col("__id")).select("text")


def _judged(column: pa.Array, model: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(base counts, mean ratio, base_failed) of each text."""
    w = Words(column)
    h = w.hashes()
    c = counts(w, h)
    bucket, row = grams(w, h)
    llr = np.bincount(row, model[bucket], minlength=w.docs) / np.maximum(np.bincount(row, minlength=w.docs), 1)
    return c, llr, (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def threshold_of(rows: list[tuple[float, int]], dear: int = DEAR) -> float:
    """The ratio from which texts are kept: fewest wrong of (ratio, label) rows, a good text lost counting `dear` times, and the
    lowest of several such; halfway between the rows on both sides. Without a good or a poor row every text is kept.
    """
    if len({y for _, y in rows}) < 2:
        return -math.inf
    x, y = np.array(sorted(rows)).T
    # cut k: rows before the k-th go
    wrong = np.concatenate(([0], np.cumsum(np.where(y == 1, dear, -1)))) + int((y == 0).sum())
    wrong[1:-1][x[1:] == x[:-1]] = np.iinfo(np.int64).max
    k = int(wrong.argmin())
    return -math.inf if k == 0 else math.inf if k == len(x) else float((x[k - 1] + x[k]) / 2)


def threshold_over(rows: DataFrame, dear: int = DEAR) -> float:
    """threshold_of a table (llr, label): running sums over ranges of ratios; one row reaches the driver."""
    good, poor = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    each = rows.groupBy("llr").agg(good.alias("good"), poor.alias("poor"))
    before = running(each, [F.col("llr")], {"good_before": F.col("good"), "poor_before": F.col("poor")})
    # wrong of a cut before each ratio, less the poor rows of all
    cut = F.struct((dear * F.col("good_before") - F.col("poor_before")).alias("wrong"), F.col("llr").alias("at"))
    r = before.agg(F.min(cut).alias("cut"), F.sum("good").alias("good"), F.sum("poor").alias("poor"), F.min("llr").alias("least")).first()
    if not r.good or not r.poor:
        return -math.inf
    if dear * r.good < r.cut.wrong + r.poor:
        return math.inf
    if r.cut.at == r.least:
        return -math.inf
    return (each.where(F.col("llr") < r.cut["at"]).agg(F.max("llr")).first()[0] + r.cut["at"]) / 2


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(ratios, threshold): the corpus's counts over all rows; all labels outside the held-out fold, and no others."""
    model = ratios(multinomial(trusted_texts(docs, labels)), multinomial(docs))
    judged = judge(docs.where(~held_out()), model).where("not base_failed").select(F.col("doc_id").alias("__d"), "llr")
    # ratios and ids are what is shuffled
    rows = judged.join(of_rows(labels, "quality").hint("shuffle_hash"), F.col("__d") == F.col("__id")).select("llr", "label")
    return model, threshold_over(stash(rows, "ratios"))


def judge(docs: DataFrame, model: np.ndarray, threshold: float = -math.inf) -> DataFrame:
    """doc_id, the base counts, llr (mean ratio of the text's n-grams), base_failed, kept of every row.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. A row that doesn't fail is kept if
    llr >= threshold. Null or empty text: zeros, llr 0, base_failed. Repeated rows fare alike; other columns are not read.
    Rows are not moved. No rows: none.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, llr, failed = _judged(batch.column(1), model)
        arrays = [batch.column(0), *map(pa.array, c.values()), pa.array(llr), pa.array(failed), pa.array(~failed & (llr >= threshold))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *c, "llr", "base_failed", "kept"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, {COUNTS}, llr double, base_failed boolean, kept boolean")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; see train and judge. A label of a document that isn't there is not used; a null text has no words; equal rows fare alike; no rows: none."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, *train(docs, labels))
