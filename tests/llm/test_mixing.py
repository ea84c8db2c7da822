"""Operator 6 where rows are alike, sources are many and budgets end within a group."""

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from lodestrata.llm import common, mixing
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, full string, place int"


def rows(n=240):
    """Half of the rows are alike, in one source; ids are null, repeated and distinct."""
    out = [(None, "a b c d e", "hot", "x", 1)] * (n // 2)
    out += [(i % 9 or None, "w " * (i % 5), ("s", "t", None, "hot")[i % 4], "y", i) for i in range(n // 2)]
    return out


def expected(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [d[:3] for d in docs])
    return Counter(con.execute(mixing.OP6_SQL).fetchall())


def test_alike_rows(spark):
    docs = rows()
    plan = mixing.mixing_plan(spark.createDataFrame(docs, SCHEMA)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, plan)) == expected(docs)
    assert max(Counter(r.taken for r in plan if r.doc_id is None and r.size == 5).values()) < 120


def test_stage_numbers_alike_rows(spark, tmp_path):
    docs = rows()
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, SCHEMA).repartition(7).write.parquet(path)
    out = corpus_pipeline.mix_sources(spark, spark.read.parquet(path), "")
    assert out.columns == ["doc_id", "text", "source", "full", "place"]
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()}
    want = Counter()
    for r in mixing.mixing_plan(spark.read.parquet(path)).collect():
        want[r.source] += r.taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}


def test_many_sources(spark):
    docs = [(i, "w " * (1 + i % 11), f"source {i % 173}") for i in range(1500)]
    plan = mixing.mixing_plan(spark.createDataFrame(docs, "doc_id long, text string, source string")).select("doc_id", "size", "source_size", "target", "taken")
    assert Counter(map(tuple, plan.collect())) == expected(docs)


@pytest.mark.parametrize("text, n, want", [("a b\n\nc  d", 3, "a b\n\nc"), ("\n a b", 1, "\n a"), ("a", 1, "a"), ("a b", 0, "")])
def test_first_words(spark, text, n, want):
    df = spark.createDataFrame([(text, n)], "text string, n int")
    assert df.select(corpus_pipeline._first_words(F.col("text"), F.col("n")).alias("x")).first().x == want
