"""The Merkle manifest against a plain recursive version, its SQL, and rows that were changed."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from lodestrata.llm import manifest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes, a):
    """(root, siblings of each node from the bottom up, as (before, after))."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // a * a : i // a * a + a]
            proofs[k].append(("".join(run[: i % a]), "".join(run[i % a + 1 :])))
            at[k] = i // a
        nodes = [h("".join(nodes[i : i + a])) for i in range(0, len(nodes), a)]
    return nodes[0], proofs


def plain(rows, a=3):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {s: climb([leaf(r) for r in trees[s]], a) for s in order}
    root, ends = climb([built[s][0] for s in order], a) if order else (None, [])
    out = []
    for s, end in zip(order, ends):
        subroot, proofs = built[s]
        for r, proof in zip(trees[s], proofs):
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                seen = (*r[:4], r[4].replace("\n", ""))
            got = leaf(seen)
            for before, after in proof + end:
                got = h(before + got + after)
            out.append((r[0], leaf(r), subroot, root, h("".join(b + c for b, c in proof + end)), got, got == root))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_tables(spark, sf):
    rows = duckdb.sql(f"select doc_id, source, lang, n_chars, text from '{sf}/documents.parquet'").fetchall()
    got = result(manifest.op12_merkle_manifest(spark, sf))
    assert got == plain(rows) and {r[-1] for r in got} == {True, False}
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(duckdb.sql(manifest.OP12_SQL).fetchall(), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, n long, idx string, proof int"
LONG = "word \n" * 40_000
ROWS = [
    (1, "a", "en", 3, "a\nb"),
    (2, None, None, None, None),
    (None, "a", "en", 3, "x"),
    (None, "a", "en", 3, "x"),
    (None, "b", "en", 3, "\n"),
    (3, "", "-", 0, ""),
    (4, "é", "en", None, LONG),
    (5, "z", "en", 1, "alone\n"),
    (6, "\U0001f600", "en", 1, "alone"),
    *[(k, "hot", "en", k, f"text\n{k}") for k in range(7, 90)],
    (7, "hot", "en", 7, "the same id"),
]


@pytest.mark.parametrize("n", [0, 1, 2, len(ROWS)])
def test_edges(spark, tmp_path, n):
    rows = ROWS[:n]
    spark.createDataFrame([(*r, "t", 1, "i", 2) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert result(manifest.op12_merkle_manifest(spark, str(tmp_path))) == plain(rows)


def test_other_arity_and_changed_rows(spark):
    """Any arity; a row with one changed field, or at another's place, is found out."""
    docs = spark.createDataFrame([(*r, "t", 1, "i", 2) for r in ROWS], SCHEMA)
    for a in (2, 5):
        fields = [F.col(c) for c in manifest.FIELDS]
        changed = manifest.leaf_digest([F.concat(F.coalesce("lang", F.lit("")), F.lit("?")) if c == "lang" else F.col(c) for c in manifest.FIELDS])
        out, tops = manifest.manifest(docs, arity=a, carry={"own": manifest.leaf_digest(fields), "other": changed})
        want = {r[1]: r[2:4] for r in plain(ROWS, a)}
        rows = out.select("leaf", "subroot", "root", manifest.fold(F.col("own"), F.col("proof")).alias("own"), manifest.fold(F.col("other"), F.col("proof")).alias("other")).collect()
        assert len(rows) == len(ROWS) and all((r.subroot, r.root) == want[r.leaf] and r.own == r.root != r.other for r in rows)
        assert {r.root for r in tops.collect()} == {r.root for r in rows} and tops.count() == len({r[1] for r in ROWS})


def test_tree_of_many_ranges(spark):
    """One tree over all partitions: its places are 0 to n - 1 in order of the key, and no task held it whole."""
    rows = spark.range(5000).select(F.lit("hot").alias("tree"), F.col("id").alias("key"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    forest = manifest.grow(rows.repartition(8), [F.col("key")], 3)
    assert len(forest.levels) == 9 and forest.levels[0].where("idx <> key or n <> 5000").count() == 0
    assert manifest.roots(forest).count() == 1
    assert manifest.prove(forest).where("size(proof) = 8").count() == 5000
