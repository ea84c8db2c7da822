"""English analysis for full-text search: tokens, stop words, stems."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.stem import SPECIAL, STOP_WORDS, stem

TOKEN = r"(?U)[\p{L}\p{N}_]+"
#: Bytes of tokens that are packed at once.
SLICE = 8 << 20


def query_lexemes(query: str) -> list[str]:
    """Distinct stems of a query's tokens, in order."""
    words = [w for w in re.findall(r"\w+", query.lower()) if w not in STOP_WORDS]
    return list(dict.fromkeys(map(stem, words)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def stems(words: Column) -> Column:
    """The stem of each word, in Arrow batches: for distinct words."""

    @F.udf("string", useArrow=True)
    def stemmed(word):
        return stem(word)

    return stemmed(words)


def postings(entities: DataFrame, segments: dict[str, str], lexemes: list[str] | None = None) -> DataFrame:
    """entity_type, entity_id, lexeme, pos, weight of every indexed token.

    segments: column -> weight letter, in the order in which they are joined; later ones' positions follow on. Stop words
    hold a place and are not indexed. Stemming runs once for each distinct word, not for each token.
    lexemes: only postings of entities that may hold them all, and of tokens that may have them as stem, for one search
    without an index. A stem differs from its word's beginning in two letters at most, so a token's first letters tell; the few
    words whose stems are given share their first letter with them.
    """
    given = set(SPECIAL.values())
    begins = [x[:1] if x in given else x[: max(1, len(x) - 2)] for x in lexemes or []]
    tagged = F.concat(*[F.transform(tokens(F.col(c)), _tag(letter)) for c, letter in segments.items()])
    placed = F.transform(tagged, lambda t, i: F.struct((i + 1).alias("pos"), t["word"].alias("word"), t["weight"].alias("weight")))
    if lexemes is not None:
        whole = F.lower(F.concat_ws(" ", *segments))
        entities = entities.where(reduce(lambda a, b: a & b, [F.contains(whole, F.lit(b)) for b in begins], F.lit(bool(begins))))
        placed = F.filter(placed, lambda t: reduce(lambda a, b: a | b, [t["word"].startswith(b) for b in begins], F.lit(False)))
    rows = entities.select("entity_type", "entity_id", F.explode(placed).alias("t")).select("entity_type", "entity_id", "t.pos", "t.word", "t.weight")
    rows = rows.where(~F.col("word").isin(STOP_WORDS))

    words = rows.select("word").distinct().withColumn("lexeme", stems(F.col("word")))
    if lexemes is not None:
        words = words.where(F.col("lexeme").isin(lexemes))
    return rows.join(words, "word").select("entity_type", "entity_id", "lexeme", "pos", "weight")


def _tag(letter: str):
    return lambda t: F.struct(t.alias("word"), F.lit(letter).alias("weight"))


def lengths(entities: DataFrame, segments: dict[str, str]) -> DataFrame:
    """entity_type, entity_id, len: indexed tokens of each entity that has any."""
    held = lambda c: F.size(F.filter(tokens(F.col(c)), lambda t: ~t.isin(STOP_WORDS)))
    rows = entities.select("entity_type", "entity_id", reduce(lambda a, b: a + b, map(held, segments)).cast("long").alias("len")).where("len > 0")
    return rows.groupBy("entity_type", "entity_id").agg(F.sum("len").alias("len"))


def packed(entities: DataFrame, segments: dict[str, str]) -> DataFrame:
    """postings as a row for each row of entities and lexeme: entity_type, entity_id, lexeme, at (places, ascending), marks (their weights' letters).

    Nothing is shuffled: a token is never a row. Stemming runs once for each distinct word of some thousand texts.
    """
    letters = "".join(segments.values()).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                yield packed_batch(batch.slice(at, step), letters)

    return token_rows(entities, segments).mapInArrow(run, "entity_type string, entity_id bigint, lexeme string, at array<int>, marks string")


def token_rows(entities: DataFrame, segments: dict[str, str]) -> DataFrame:
    """entity_type, entity_id and the tokens of each segment."""
    return entities.select("entity_type", F.col("entity_id").cast("long").alias("entity_id"), *[tokens(F.col(c)).alias(f"__{c}") for c in segments])


def packed_batch(batch: pa.RecordBatch, letters: bytes) -> pa.RecordBatch:
    """Rows of token_rows as those of packed, in order of lexeme and row."""
    row, pos, mark, words = [], [], [], []
    before = np.zeros(batch.num_rows, np.int64)
    for i in range(len(letters)):
        column = batch.column(2 + i)
        size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        row.append(np.repeat(np.arange(len(size), dtype=np.int32), size))
        pos.append(np.arange(size.sum(), dtype=np.int32) + np.repeat((before - first + 1).astype(np.int32), size))
        mark.append(np.full(size.sum(), letters[i], np.uint8))
        words.append(column.flatten())
        before += size
    coded = pa.concat_arrays(words).dictionary_encode()
    stop = set(STOP_WORDS)
    found = pa.array([None if w in stop else stem(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    by_name = pc.array_sort_indices(found.dictionary)
    lexemes = found.dictionary.take(by_name)
    # the last, -1, is that of stop words
    nth = np.full(len(by_name) + 1, -1, np.int32)
    nth[by_name.to_numpy()] = np.arange(len(by_name))
    code = nth[found.indices.fill_null(-1).to_numpy()][coded.indices.to_numpy()]
    row, pos, mark = (np.concatenate(x) for x in (row, pos, mark))
    # a row's tokens stand in order of their places
    order = np.argsort(code.astype(np.int64) * batch.num_rows + row, kind="stable")
    order = order[int((code < 0).sum()) :]
    code, row = code[order], row[order]
    start = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])))[: len(code)])
    offsets = pa.array(np.append(start, len(code)), pa.int32())
    at = pa.ListArray.from_arrays(offsets, pa.array(pos[order], pa.int32()))
    marks = pa.StringArray.from_buffers(len(start), offsets.buffers()[1], pa.py_buffer(mark[order]))
    own = pa.array(row[start])
    arrays = [batch.column(0).take(own), batch.column(1).take(own), lexemes.take(pa.array(code[start])), at, marks]
    return pa.RecordBatch.from_arrays(arrays, names=["entity_type", "entity_id", "lexeme", "at", "marks"])
