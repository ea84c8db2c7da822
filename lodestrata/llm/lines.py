"""Operator 3: passages of lines, removed where they repeat anywhere in the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD, Words, by_batch, fresh, mix, span_hashes, stash
from lodestrata.llm.tokenizing import spread

#: Words of a chunk, about; words of a passage, at least.
CUT, LEAST = 12, 50
#: A line that is not blank.
INK = r"[^\x20\x09-\x0D]"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LINES = "array<struct<h:bigint,words:int,pos:int>>"
#: A document: rows equal in doc_id and text are one. th: the text's hash.
_DOC = ["doc_id", "th"]


class Lines:
    """Lines with a word of every row of a batch, as arrays: doc (row number), pos (among all of its lines), h, words; cut into chunks.

    A rolling hash over a line's hash and that of the one before decides whether a chunk ends with it, with odds of its words to
    `cut`, so that chunks have some `cut` words and their ends depend on two lines alone: text put in or left out moves no other end.
    A line of `cut` words or more is a chunk of its own. Blank lines are passed over.
    """

    def __init__(self, column: pa.Array, cut: int) -> None:
        w = Words(column)
        feeds = np.flatnonzero(w.data == 0x0A)
        # where lines start: at each row's start and after each line feed
        starts = np.unique(np.concatenate((w.offsets[:-1], feeds + 1)))
        # the empty line after a feed at a row's end, which has the next row's offset, is left out
        starts = starts[starts < w.offsets[-1]]
        row = np.searchsorted(w.offsets, starts, "right") - 1
        ends = np.append(starts[1:], w.offsets[-1])[: len(starts)]
        words = np.searchsorted(w.start, ends) - np.searchsorted(w.start, starts)
        pos = np.arange(len(starts)) - np.searchsorted(starts, w.offsets[row])
        # without the feed itself
        ends = ends - (w.data[ends - 1] == 0x0A)
        ink = words > 0
        self.doc, self.pos, self.words = row[ink], pos[ink].astype(np.int32), words[ink].astype(np.int32)
        self.h = span_hashes(w.data, starts[ink], ends[ink])
        n = len(self.h)
        new_doc = np.ones(n, bool)
        new_doc[1:] = self.doc[1:] != self.doc[:-1]
        before = np.zeros(n, np.uint64)
        before[1:] = np.where(new_doc[1:], np.uint64(0), self.h[:-1])
        rolled = mix(before * _BASE + self.h) >> np.uint64(32)
        stop = rolled * np.uint64(cut) < self.words.astype(np.uint64) << np.uint64(32)
        start = new_doc.copy()
        start[1:] |= stop[:-1] | (self.words[1:] >= cut)
        self.start = np.flatnonzero(start)
        self.size = np.diff(np.append(self.start, n))
        #: A line's number among those of its document.
        self.nth = (np.arange(n) - np.maximum.accumulate(np.where(new_doc, np.arange(n), 0))).astype(np.int32)

    def keys(self) -> np.ndarray:
        """A hash of each chunk's lines, in order."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        within = (np.arange(len(self.h)) - np.repeat(self.start, self.size)).astype(np.uint64)
        return mix(np.add.reduceat(mix(self.h ^ mix(within + np.uint64(1))), self.start))

    def lists(self, near: int) -> pa.Array:
        """For each chunk the lines of the one after it in its document (near = 1), or of the one before and one line more (-1).

        Whether a chunk ends with a passage's first line depends on the line before it; on all others' the passage decides. So
        what a passage has before its first whole chunk lies in these lines.
        """
        k = np.arange(len(self.start))
        at = np.clip(k + near, 0, max(len(k) - 1, 0))
        ok = (at != k) & (self.doc[self.start[at]] == self.doc[self.start])
        start = self.start[at] - ((near < 0) & (self.nth[self.start[at]] > 0))
        size = np.where(ok, self.start[at] + self.size[at] - start, 0)
        i = spread(start, size)
        of = pa.StructArray.from_arrays([pa.array(self.h[i].view(np.int64)), pa.array(self.words[i]), pa.array(self.pos[i])], names=["h", "words", "pos"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), of)


def line_chunks(docs: DataFrame, cut: int = CUT) -> DataFrame:
    """(doc_id, th, nth, first, last, words, key, before, after) of each chunk.

    nth: its first line's number among those with a word; first, last: its lines' places among all; words: of each line;
    before, after: lines next to it, see Lines.lists.
    """

    def cuts(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch.column("text"), cut)
        a, size = lines.start, lines.size
        rows = pa.array(lines.doc[a])
        words = pa.ListArray.from_arrays(pa.array(np.append(a, len(lines.h)).astype(np.int32)), pa.array(lines.words))
        columns = [batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(lines.nth[a]), pa.array(lines.pos[a]), pa.array(lines.pos[a + size - 1])]
        columns += [words, pa.array(lines.keys().view(np.int64)), lines.lists(-1), lines.lists(1)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "nth", "first", "last", "words", "key", "before", "after"])

    keyed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return by_batch(keyed, cuts, f"doc_id bigint, th bigint, nth int, first int, last int, words array<int>, key bigint, before {_LINES}, after {_LINES}")


def _same(a: Column, b: Column) -> Column:
    """How many lines two lists have in common at their beginnings, by hash."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))), False)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def _islands(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """rows and `island`: a number for each set of intervals [start, end] within `by` that overlap or touch."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("island", F.sum(F.when(F.col(start) <= reach + 1, 0).otherwise(1)).over(w))


def proposals(docs: DataFrame, cut: int = CUT, least: int = LEAST) -> DataFrame:
    """(doc_id, th, first, last, doc_id_0, th_0, first_0, last_0): passages and the earlier place of their chunks, by hashes alone.

    Each repeated chunk is held against its first place by (doc_id, th, line), null doc_id first. Equal lines next to it on both
    sides come with it; pieces of one document at one distance from their first places that overlap
    or touch are one passage. Passages under `least` words are left alone.
    """
    # tables of their own, here and below, so that texts are read once, joins stand alone and Spark may split what is very common
    unit = stash(line_chunks(docs, cut), "chunks")
    place = F.struct("doc_id", "th", "nth")
    kept = unit.groupBy("key").agg(F.min(place).alias("kept"), F.max(place).alias("other")).where("not kept <=> other").select("key", "kept")
    found = stash(unit.join(stash(kept, "kept"), "key"), "repeats")
    is_first = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th")) & (F.col("nth") == F.col("kept.nth"))
    # rows alike have one first place
    source = found.where(is_first).dropDuplicates(["key"])
    source = stash(source.select("key", *[F.col(c).alias(f"{c}_0") for c in ("first", "last", "before", "after")]), "firsts")
    both = found.where(~is_first).dropDuplicates([*_DOC, "nth"]).join(source, "key")
    up, down = _same(F.reverse("before"), F.reverse("before_0")), _same(F.col("after"), F.col("after_0"))
    both = both.withColumns({"up": up, "down": down})
    edge = lambda c, n, end, whole: F.when(F.col(n) > 0, F.get(c, F.size(c) - F.col(n) if end else F.col(n) - 1)["pos"]).otherwise(F.col(whole))
    sides = {f"first{s}": edge(f"before{s}", "up", True, f"first{s}") for s in ("", "_0")} | {f"last{s}": edge(f"after{s}", "down", False, f"last{s}") for s in ("", "_0")}
    size, numbered = F.size("words"), lambda lines, start: F.transform(lines, lambda x, i: F.struct((start + i).alias("n"), x.alias("w")))
    top = F.transform(F.slice("before", F.size("before") - F.col("up") + 1, F.col("up")), lambda x: x["words"])
    bottom = F.transform(F.slice("after", F.lit(1), F.col("down")), lambda x: x["words"])
    lines = numbered(F.concat(top, "words", bottom), F.col("nth") - F.col("up"))
    source = [F.col("kept.doc_id").alias("doc_id_0"), F.col("kept.th").alias("th_0"), (F.col("nth") - F.col("kept.nth")).alias("apart")]
    reach = [(F.col("nth") - F.col("up")).alias("a"), (F.col("nth") + size + F.col("down") - 1).alias("b")]
    by = [*_DOC, "doc_id_0", "th_0", "apart"]
    parts = _islands(both.select(*_DOC, *source, *reach, *[c.alias(k) for k, c in sides.items()], lines.alias("lines")), by, "a", "b")
    ends = {"first": F.min, "last": F.max, "first_0": F.min, "last_0": F.max}
    # lines of pieces that overlap count once
    once = parts.select(*by, "island", *ends, F.explode("lines").alias("x")).groupBy(*by, "island", F.col("x.n").alias("n"))
    once = once.agg(F.max("x.w").alias("w"), *[f(c).alias(c) for c, f in ends.items()])
    whole = once.groupBy(*by, "island").agg(F.sum("w").alias("w"), *[f(c).alias(c) for c, f in ends.items()])
    return whole.where(F.col("w") >= least).select(*_DOC, "first", "last", "doc_id_0", "th_0", "first_0", "last_0")


def _inked(text: Column, first: Column, last: Column) -> Column:
    """The lines with a word between two places of a text, joined."""
    return F.array_join(F.filter(F.slice(F.split(text, "\n", -1), first + 1, last - first + 1), lambda x: x.rlike(INK)), "\n")


def _passage_texts(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (doc_id, th, first, last) and the text of each: a document is met once, with the ranges asked of it."""
    asked = ranges.distinct().groupBy(*_DOC).agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "__d", "th": "__t"})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").join(asked, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")))
    each = own.select(*_DOC, "text", F.explode("asked").alias("r")).select(*_DOC, "r.first", "r.last", _inked(F.col("text"), F.col("r.first"), F.col("r.last")).alias("passage"))
    return each.groupBy(*_DOC, "first", "last").agg(F.first("passage").alias("passage"))


def repeated_passages(docs: DataFrame, cut: int = CUT, least: int = LEAST) -> DataFrame:
    """(doc_id, th, first, last) of the passages that stand earlier too, byte for byte; they may overlap.

    See proposals for what is compared. A passage of which one byte differs from its earlier place is left whole.
    """
    found = stash(proposals(docs, cut, least), "proposals")
    source = found.select(F.col("doc_id_0").alias("doc_id"), F.col("th_0").alias("th"), F.col("first_0").alias("first"), F.col("last_0").alias("last"))
    texts = stash(_passage_texts(docs, found.select(*_DOC, "first", "last").unionByName(source)), "passages")
    for side in ("", "_0"):
        near = texts.withColumnsRenamed({"doc_id": "__d", "th": "__t", "first": "__f", "last": "__l", "passage": f"passage{side}"})
        at = F.col(f"doc_id{side}").eqNullSafe(F.col("__d")) & (F.col(f"th{side}") == F.col("__t")) & (F.col(f"first{side}") == F.col("__f")) & (F.col(f"last{side}") == F.col("__l"))
        found = found.join(near, at).drop("__d", "__t", "__f", "__l")
    return found.where("passage = passage_0").select(*_DOC, "first", "last")


def dedup_lines(docs: DataFrame, cut: int = CUT, least: int = LEAST) -> tuple[DataFrame, str, str, str]:
    """(docs with three more columns, and their names): what is left of the text, passages removed, words removed.

    Every row and column stays; null text stays null. Lines are parted by \\n; blank ones stay. A passage of `least` words or
    more goes where it stands earlier by (doc_id, hash of the text, line), so each of its lines is left somewhere. Equal rows
    (doc_id and text) are one place: all of them keep or lose the same lines. No rows: none.
    """
    d, h, gone, left, passages, words = fresh(docs, "__d", "__h", "__gone", "__left", "__passages", "__words")
    runs = _islands(repeated_passages(docs, cut, least), _DOC, "first", "last").groupBy(*_DOC, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    lost = runs.groupBy(F.col("doc_id").alias(d), F.col("th").alias(h)).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("x"))
    # a flag for each line up to the last that goes, so that each line is looked up once
    before = lambda i: F.coalesce(F.get("x", i - 1)["last"], F.lit(-1))
    flags = F.flatten(F.transform("x", lambda x, i: F.concat(F.array_repeat(F.lit(False), x["first"] - before(i) - 1), F.array_repeat(F.lit(True), x["last"] - x["first"] + 1))))
    lost = lost.select(d, h, F.size("x").cast("long").alias(passages), flags.alias(gone))
    both = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left")
    goes = lambda x, i: F.coalesce(F.get(gone, i), F.lit(False)) & x.rlike(INK)
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~goes(x, i)), "\n")
    n = F.regexp_count(F.array_join(F.filter(F.split("text", "\n", -1), goes), "\n"), F.lit(WORD))
    both = both.withColumn(left, F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest))
    both = both.withColumn(words, F.when(F.col(gone).isNull(), 0).otherwise(n).cast("long")).withColumn(passages, F.coalesce(passages, F.lit(0).cast("long")))
    return both.drop(d, h, gone), left, passages, words


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What line dedup leaves of all documents; see dedup_lines for nulls, ties, repeated rows and empty tables. A null text counts as empty here."""
    out, left, passages, words = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce(left, F.lit(""))
    return out.select("doc_id", F.col(passages).alias("n_chunks_removed"), F.col(words).alias("n_words_removed"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
