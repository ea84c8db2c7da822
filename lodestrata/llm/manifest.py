"""Operator 12: a Merkle manifest of a dataset, a proof for each row, and rows checked against it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import partitions, stash
from lodestrata.llm.resample import CRC_TABLE, crc_sql

#: Consecutive nodes that become one; the fields of a leaf; one document in TAMPERED loses its line feeds in the query.
ARITY, FIELDS, TAMPERED = 3, ("doc_id", "source", "lang", "n_chars", "text"), 2
#: Joins from the top down that one plan holds.
CHAIN = 4


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex digest of the fields as text, each with its length in bytes, `-` for a null."""
    text = [c.cast("string") for c in fields]
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give: at each level the digest of its siblings to the left, itself and those to the right."""
    return F.aggregate(proof, leaf, lambda got, s: sha(F.concat(_hex(s["before"]), got, _hex(s["after"]))))


def proof_digest(proof: Column) -> Column:
    """Hex digest of all siblings in a proof, level by level."""
    return sha(F.array_join(F.transform(proof, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""))


@dataclass
class Forest:
    """Trees of one arity, all rows of a level in one stored table.

    levels[0] has a row for each leaf (tree, n: nodes of its tree at this level, idx, digest, and what was carried), the
    others one for each inner node with its children's digests (kids). A tree ends at the level where n is 1.
    """

    levels: list[DataFrame]
    arity: int


def grow(rows: DataFrame, order: Sequence[Column], arity: int) -> Forest:
    """Trees over rows (tree, digest, ...) in some order within each tree.

    Rows are dealt out by ranges of (tree, order), so that a tree of any size is many tasks; a row's place is the sum of
    its tree's earlier ranges and its number within its own. Each level is a table, grouped from the one below by
    (tree, idx div arity): `arity` digests a group.
    """
    spark = rows.sparkSession
    order = [*order, F.col("digest")]
    ranges = stash(rows, "leaves").repartitionByRange(partitions(spark), F.col("tree").asc_nulls_first(), *order)
    dealt = stash(ranges.withColumn("__part", F.spark_partition_id()), "ranges")
    # a row for each tree and each range that it lies in
    parts = dealt.groupBy("tree", "__part").count()
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("count").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("tree").alias("__of"), F.col("__part").alias("__in"), before.alias("__before"), F.sum("count").over(tree).alias("n"))
    within = F.row_number().over(Window.partitionBy("tree", "__part").orderBy(*order))
    joined = dealt.join(parts, F.col("tree").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__in")))
    level = stash(joined.withColumn("idx", F.col("__before") + within - 1).drop("__of", "__in", "__part", "__before"), "level")
    levels, most = [level], level.agg(F.max("n")).first()[0] or 1
    while most > 1:
        most = -(-most // arity)
        run = level.where("n > 1").groupBy("tree", F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.expr(f"idx div {arity}").alias("up"))
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        up = run.agg(kids.alias("kids")).withColumnRenamed("up", "idx")
        level = stash(up.withColumn("digest", F.unhex(sha(F.array_join(F.transform("kids", _hex), "")))), "level")
        levels.append(level)
    return Forest(levels, arity)


def roots(forest: Forest) -> DataFrame:
    """(tree, digest) of the trees' tops: the nodes that are alone at their level."""
    out = None
    for level in forest.levels:
        top = level.where("n = 1").select("tree", "digest")
        out = top if out is None else out.unionByName(top)
    return out


def prove(forest: Forest, tops: DataFrame | None = None) -> DataFrame:
    """levels[0] and, for each of its rows, a proof: array of (before, after), the joined digests of its siblings level by level.

    From the top down: each level is joined to the level above it on (tree, idx div arity), and each child puts its
    siblings before the proof that its parent hands on. tops: (tree, proof, ...) that the trees' tops start from, an
    empty proof by default; its other columns are handed on too.
    """
    empty = F.array().cast("array<struct<before:binary,after:binary>>")
    a = forest.arity
    held = None
    for k in reversed(range(len(forest.levels))):
        level = forest.levels[k]
        if tops is None:
            found = level.where("n = 1").withColumn("proof", empty)
        else:
            found = level.where("n = 1").join(tops.withColumnRenamed("tree", "__of"), F.col("tree").eqNullSafe(F.col("__of"))).drop("__of")
        if held is not None:
            above = held.drop("n", "digest").withColumnsRenamed({"tree": "__of", "idx": "__up", "kids": "__run", "proof": "__proof"})
            both = level.where("n > 1").join(above, F.col("tree").eqNullSafe(F.col("__of")) & (F.expr(f"idx div {a}") == F.col("__up")))
            at = F.expr(f"cast(idx % {a} as int)")
            beside = lambda start, size: F.unhex(F.array_join(F.transform(F.slice("__run", start, size), F.hex), ""))
            own = F.struct(beside(F.lit(1), at).alias("before"), beside(at + 2, F.lit(a)).alias("after"))
            found = found.unionByName(both.withColumn("proof", F.concat(F.array(own), "__proof")).drop("__of", "__up", "__run", "__proof"))
        held = stash(found, "proofs") if k and k % CHAIN == 0 else found
    return held


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "source", key: str = "doc_id", arity: int = ARITY, carry: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """((tree, key, carried columns, leaf, subroot, root, proof) for each row of docs, (tree, subroot, root) for each tree).

    A leaf is the digest of a row's fields. The rows of one `tree` value, by key, form a tree; the trees' tops, by that
    value in order of bytes, form the tree of the root. Nulls come first in both and are a value of their own. Rows
    alike in tree and key are ordered by digest; equal rows are leaves of their own. Digests are hex text, those within
    a proof binary; fold(leaf, proof) is the root exactly where neither was changed. Other columns are not read.
    No rows: none.
    """
    row = docs.select(F.col(tree).alias("tree"), F.col(key).alias("key"), F.unhex(leaf_digest([F.col(c) for c in fields])).alias("digest"), *[c.alias(f"_{k}") for k, c in (carry or {}).items()])
    trees = grow(row, [F.col("key").asc_nulls_first()], arity)
    under = roots(trees).select(F.lit(0).alias("tree"), F.col("tree").alias("of"), "digest")
    top = grow(under, [F.col("of").asc_nulls_first()], arity)
    # one digest
    root = [bytes(r.digest) for r in roots(top).select("digest").collect()]
    ends = prove(top).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.lit(root[0] if root else None).cast("binary").alias("root"), "proof")
    ends = stash(ends, "roots")
    named = [_hex(F.col(c)).alias(c) for c in ("subroot", "root")]
    proven = prove(trees, ends).select("tree", "key", *[F.col(f"_{k}").alias(k) for k in carry or {}], _hex(F.col("digest")).alias("leaf"), *named, "proof")
    return proven, ends.select("tree", *named)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents, held against rows of which every second lost its line feeds; see manifest for nulls, ties and repeats.

    A null doc_id is never tampered with; a null text stays null.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    seen = F.unhex(leaf_digest([text if c == "text" else F.col(c) for c in FIELDS]))
    out, _ = manifest(docs, carry={"seen": seen})
    out = out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(_hex(F.col("seen")), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({x})::varchar)::varchar || ':' || ({x})::varchar, '-')" for x in [*FIELDS[:-1], text]) + ")"


def _tree_sql(name: str, rows: str, tree: str) -> str:
    """A level's nodes from those of the level below, until one is left."""
    return f"""{name} AS (
  SELECT {tree} AS tree, 0 AS level, idx, n, digest FROM {rows}
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 3, n)"""


def _path_sql(name: str, rows: str, nodes: str, tree: str) -> str:
    """For each leaf and level, its siblings before and after it."""
    return f"""{name} AS (
  SELECT p.row, p.level, string_agg(x.digest, '' ORDER BY x.idx) FILTER (x.idx < p.own) AS before, string_agg(x.digest, '' ORDER BY x.idx) FILTER (x.idx > p.own) AS after
  FROM (SELECT row, tree, level, idx // (3 ** level)::bigint AS own FROM (SELECT row, {tree} AS tree, idx, unnest(range(39)) AS level FROM {rows})) p
  JOIN {nodes} x ON p.tree IS NOT DISTINCT FROM x.tree AND p.level = x.level AND p.own // 3 = x.idx // 3 AND x.n > 1
  GROUP BY p.row, p.level)"""


OP12_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS digest,
    CASE WHEN {crc_sql("doc_id::varchar")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS seen
  FROM documents, {CRC_TABLE}),
placed AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n FROM leaf),
{_tree_sql("node", "placed", "source")},
subroot AS (
  SELECT tree AS source, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
{_tree_sql("upper_node", "subroot", "0")},
top AS (SELECT digest AS root FROM upper_node WHERE n = 1),
{_path_sql("path", "placed", "node", "source")},
{_path_sql("upper_path", "(SELECT *, idx AS row FROM subroot)", "upper_node", "0")},
whole AS (
  SELECT row, level, before, after FROM path
  UNION ALL
  SELECT p.row, 64 + u.level, u.before, u.after FROM placed p JOIN subroot s ON p.source IS NOT DISTINCT FROM s.source JOIN upper_path u ON u.row = s.idx),
proof AS (SELECT row, list(coalesce(before, '') || '|' || coalesce(after, '') ORDER BY level) AS steps FROM whole GROUP BY row),
folded AS (
  SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, root, sha256(replace(coalesce(array_to_string(steps, ''), ''), '|', '')) AS proof_sha256,
    list_reduce([p.seen] || coalesce(steps, []), lambda got, x: sha256(split_part(x, '|', 1) || got || split_part(x, '|', 2))) AS folded_root
  FROM placed p LEFT JOIN proof USING (row) JOIN subroot s ON p.source IS NOT DISTINCT FROM s.source, top)
SELECT *, folded_root = root AS verified FROM folded"""
