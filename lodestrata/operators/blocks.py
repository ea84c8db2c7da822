"""Postings in blocks: a row for each lexeme and block of entities, with a bound on what the block can score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import analyze

#: Weights of the segments of a search document.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Entities of a block, about; blocks read at once, growing until no other can enter; beyond the last all are read.
PER_BLOCK, STEPS = 512, (32, 512, 4096)
#: Bytes of tokens whose blocks are made at once and sorted by lexeme; rows that a task gives at once.
RUN, GIVEN = 8 << 20, 10_000
SCHEMA = "repo_id bigint, entity_type string, lexeme string, block bigint, n bigint, best double, most int, top double, entities array<struct<entity_id:bigint,at:array<int>,marks:string>>"
#: Of one row of a block: its entities' lengths.
OWN = "own array<struct<entity_id:bigint,len:bigint>>"


@dataclass(frozen=True)
class BlockIndex:
    """blocks, in order of lexeme, and lengths (repo_id, entity_type, entity_id, len)."""

    blocks: DataFrame
    lengths: DataFrame

    def of(self, types: set[str] | None, repo_id: int | None) -> DataFrame:
        rows = self.blocks if types is None else self.blocks.where(F.col("entity_type").isin(*sorted(types)))
        return rows if repo_id is None else rows.where(F.col("repo_id") == repo_id)


def weight_of(letter: Column) -> Column:
    return reduce(lambda out, kv: F.when(letter == kv[0], kv[1]).otherwise(out), WEIGHTS.items(), F.lit(0.0))


def block_postings(postings: DataFrame, lengths: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """Blocks of postings (repo_id, entity_type, entity_id, lexeme, pos, weight).

    An entity's block is a hash of its id, the same for every lexeme, so that blocks of several lexemes meet. n: entities;
    best: the largest sum of weights of one; most: the largest number of places of one; top: the largest weight. A frequent
    lexeme has as many rows as there are blocks. marks: the weights' letters, place by place.
    """
    keys = ["repo_id", "entity_type"]
    sizes = lengths.groupBy(*keys).agg(F.ceil(F.count("*") / per_block).alias("blocks"))
    each = postings.groupBy(*keys, "lexeme", "entity_id").agg(F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("x"), *[F.count_if(F.col("weight") == w).alias(f"__{w}") for w in WEIGHTS])
    impact = reduce(lambda a, b: a + b, [F.col(f"__{w}") * v for w, v in WEIGHTS.items()])
    top = F.greatest(*[F.when(F.col(f"__{w}") > 0, v).otherwise(0.0) for w, v in WEIGHTS.items()])
    entity = F.struct("entity_id", F.transform("x", lambda p: p["pos"]).alias("at"), F.array_join(F.transform("x", lambda p: p["weight"]), "").alias("marks"))
    each = each.select(*keys, "lexeme", entity.alias("e"), impact.alias("impact"), F.size("x").alias("tf"), top.alias("w")).join(sizes, keys)
    each = each.withColumn("block", F.pmod(F.xxhash64("e.entity_id"), "blocks"))
    whole = each.groupBy(*keys, "lexeme", "block").agg(F.count("*").alias("n"), F.max("impact").alias("best"), F.max("tf").alias("most"), F.max("w").alias("top"), F.sort_array(F.collect_list("e")).alias("entities"))
    return whole


def write_blocks(blocks: DataFrame, path: str, files: int) -> None:
    """In order of lexeme and block: a search reads the few row groups that hold its lexemes. Places are ascending numbers, which
    Parquet's second version codes by their differences."""
    order = ["entity_type", "lexeme", "block"]
    dealt = blocks.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#entities.list.element.at.list.element", "false").partitionBy("repo_id").parquet(path)


def write_packed(each: DataFrame, lengths: DataFrame, path: str, files: int, repo_id: int, per_block: int = PER_BLOCK) -> None:
    """The blocks of one repository as block_postings and write_blocks give them, from rows of an entity and lexeme (functions.analyze.packed).

    They are shuffled once, and sorted; blocks are then runs of rows. Rows with one entity_id are one entity's.
    """
    keys = ["entity_type", "lexeme", "block"]
    # a row for each type
    sizes = lengths.groupBy("entity_type").agg(F.ceil(F.count("*") / per_block).alias("blocks"))
    placed = each.join(F.broadcast(sizes), "entity_type").withColumn("block", F.pmod(F.xxhash64("entity_id"), "blocks"))
    dealt = placed.select(*keys, "entity_id", "at", "marks").repartition(files, *keys).sortWithinPartitions(*keys, "entity_id")
    schema = SCHEMA.replace("repo_id bigint, ", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, keys)
            if held and (len(new) > 1 or any(batch.column(k)[0] != held[0].column(k)[0] for k in keys)):
                # all rows before this batch's last block are whole
                last = int(new[-1])
                yield _gathered(pa.concat_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            elif not held and len(new) > 1:
                yield _gathered(batch.slice(0, int(new[-1])))
                held = [batch.slice(int(new[-1]))]
            else:
                held.append(batch)
        if held:
            yield _gathered(pa.concat_batches(held))

    out = dealt.mapInArrow(run, schema)
    out.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#entities.list.element.at.list.element", "false").parquet(f"{path}/repo_id={repo_id}")


def write_entities(entities: DataFrame, segments: dict[str, str], path: str, repo_id: int, per_block: int = PER_BLOCK) -> None:
    """The blocks of one repository's entities, no id of which stands in two rows, added to a path; with lengths (OWN).

    Nothing is shuffled, sorted by Spark or spilled: a block is made of neighbours within a task and numbered after its partition, from
    1 << 32, so that it meets none of write_packed. A file is runs of blocks, each in order of lexeme, and a search reads the pages of its lexemes.
    """
    letters = "".join(segments.values()).encode()
    schema = SCHEMA.replace("repo_id bigint, ", "") + ", " + OWN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() + 1 << 32
        for rows in _runs(batches, per_block):
            out = _blocks_of(rows, letters, block, per_block)
            block += -(-rows.num_rows // per_block)
            for at in range(0, out.num_rows, GIVEN):
                yield out.slice(at, GIVEN)

    out = analyze.token_rows(entities, segments).mapInArrow(run, schema)
    out.write.mode("append").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#entities.list.element.at.list.element", "false").parquet(f"{path}/repo_id={repo_id}")


def _runs(batches: Iterator[pa.RecordBatch], per_block: int) -> Iterator[pa.RecordBatch]:
    """Rows of one type, some RUN bytes at a time, whole blocks where as much holds some."""
    held: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        step = max(1, batch.num_rows * RUN // max(batch.nbytes, 1))
        step -= step % per_block if step > per_block else 0
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            kinds = part.column(0).unique()
            for kind in kinds:
                own = held.setdefault(kind.as_py(), [])
                own.append(part if len(kinds) == 1 else part.filter(pc.equal(part.column(0), kind)))
                if sum(x.nbytes for x in own) >= RUN:
                    yield pa.concat_batches(held.pop(kind.as_py()))
    yield from map(pa.concat_batches, held.values())


def _blocks_of(rows: pa.RecordBatch, letters: bytes, first: int, per_block: int) -> pa.RecordBatch:
    """Blocks, numbered from first, of rows of analyze.token_rows of one type, in order of lexeme; each row is an entity."""
    # until the blocks are made, an entity is its row's number
    numbered = rows.set_column(1, rows.schema.names[1], pa.array(np.arange(rows.num_rows)))
    packed = analyze.packed_batch(numbered, letters)
    row = packed.column("entity_id").to_numpy()
    length = np.bincount(row, weights=packed.column("at").value_lengths().to_numpy(), minlength=rows.num_rows).astype(np.int64)
    out = _gathered(packed.append_column("block", pa.array(first + row // per_block)))
    # ids, and a block's lengths beside its first row
    ids, entities = rows.column(1), out.column("entities")
    own = pa.StructArray.from_arrays([ids.take(entities.values.field("entity_id")), entities.values.field("at"), entities.values.field("marks")], ["entity_id", "at", "marks"])
    out = out.set_column(out.schema.names.index("entities"), "entities", pa.ListArray.from_arrays(entities.offsets, own))
    block, at = np.unique(out.column("block").to_numpy() - first, return_index=True)
    some = np.flatnonzero(length)
    size = np.zeros(out.num_rows, np.int64)
    size[at] = np.bincount(some // per_block)[block]
    # blocks' first rows needn't stand in the blocks' order
    order = np.concatenate([some[slice(*np.searchsorted(some // per_block, [b, b + 1]))] for b in block[np.argsort(at)]]) if len(at) else some
    lens = pa.StructArray.from_arrays([ids.take(pa.array(order)), pa.array(length[order])], ["entity_id", "len"])
    return out.append_column("own", pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), lens))


def _starts(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = rows.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _gathered(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted rows of an entity and lexeme as blocks. Places and marks stay where they are, only what divides them goes."""
    keys = ["entity_type", "lexeme", "block"]
    entity, block = _starts(rows, [*keys, "entity_id"]), _starts(rows, keys)
    ends = lambda offsets: offsets[np.append(entity, rows.num_rows)]
    at, marks = rows.column("at"), rows.column("marks")
    places = ends(at.offsets.to_numpy())
    letters = ends(np.frombuffer(marks.buffers()[1], np.int32)[marks.offset : marks.offset + len(marks) + 1])
    held = pa.StructArray.from_arrays([rows.column("entity_id").take(pa.array(entity)), pa.ListArray.from_arrays(pa.array(places), at.values),
        pa.StringArray.from_buffers(len(entity), pa.py_buffer(letters.copy()), marks.buffers()[2])], ["entity_id", "at", "marks"])
    data = np.frombuffer(marks.buffers()[2], np.uint8)
    count = {w: np.diff(np.concatenate(([0], np.cumsum(data == ord(w))))[letters]) for w in WEIGHTS}
    impact = reduce(lambda a, b: a + b, [n * WEIGHTS[w] for w, n in count.items()])
    top = reduce(np.maximum, [np.where(n > 0, WEIGHTS[w], 0.0) for w, n in count.items()])
    nth = np.searchsorted(entity, block)
    largest = lambda x: np.maximum.reduceat(x, nth)
    n = np.diff(np.append(nth, len(entity)))
    of = [rows.column(k).take(pa.array(block)) for k in keys]
    arrays = [*of, pa.array(n, pa.int64()), pa.array(largest(impact)), pa.array(largest(np.diff(letters)), pa.int32()), pa.array(largest(top)), pa.ListArray.from_arrays(pa.array(np.append(nth, len(entity)), pa.int32()), held)]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "n", "best", "most", "top", "entities"])


def unpacked(blocks: DataFrame) -> DataFrame:
    """Blocks as postings again."""
    each = blocks.select("entity_type", "lexeme", F.explode("entities").alias("e")).select("entity_type", "lexeme", "e.entity_id", "e.marks", F.posexplode("e.at").alias("i", "pos"))
    return each.select("entity_type", "entity_id", "lexeme", "pos", F.substring("marks", F.col("i") + 1, F.lit(1)).alias("weight"))


def bounds(blocks: DataFrame, lexemes: list[str]) -> DataFrame:
    """(entity_type, block, bound) of the blocks that hold every lexeme: no entity in one has a larger cover density.

    Of one lexeme: the largest sum of weights. Of several: each cover begins at a place of its own, of two lexemes two covers at
    most share a place of the rarer one, and a cover adds the harmonic mean of its weights at most.
    """
    held = blocks.where(F.col("lexeme").isin(lexemes)).groupBy("repo_id", "entity_type", "block")
    if len(lexemes) == 1:
        return held.agg(F.max("best").alias("bound"))
    covers = F.least(F.sum("most"), 2 * F.min("most")) if len(lexemes) == 2 else F.sum("most")
    bound = covers * len(lexemes) / F.sum(1 / F.col("top"))
    return held.agg(bound.alias("bound"), F.count("*").alias("of")).where(F.col("of") == len(lexemes)).drop("of")


def first_blocks(bound: DataFrame, n: int) -> tuple[DataFrame, float | None]:
    """(the n blocks of largest bound, the largest bound of the others; None: there are none). n + 1 small rows reach the driver."""
    rows = bound.orderBy(F.desc("bound"), "repo_id", "entity_type", "block").limit(n + 1).collect()
    chosen = bound.sparkSession.createDataFrame(rows[:n], bound.schema)
    return chosen, rows[n].bound if len(rows) > n else None
