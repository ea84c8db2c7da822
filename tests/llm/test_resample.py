"""Importance resampling against a plain version: longer runs, ties, repeated rows, edges; and its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from lodestrata.llm import resample

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, runs, buckets, least, share, seed):
    """{row number: (n_features, weight, score, rank)}."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    held = [features(t, runs) for _, t in docs]
    s = Counter(bucket(f) for _, fs in held for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, runs)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for k, ((doc, _), (n, fs)) in enumerate(zip(docs, held)):
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((k, doc, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    can = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[5], r[1] is not None, r[1] or 0, r[3]))
    rank = {r[0]: i + 1 for i, r in enumerate(can[: share * len(can) // 100])}
    return sorted(((r[1], r[3], r[4], r[5], rank.get(r[0])) for r in rows), key=str)


def test_ring():
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 5):
        for size in (0, 1, 2, 4, 30):
            words = [f"w{x}".encode() for x in rng.integers(0, 50, size)]
            want = Counter(zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, n + 1) for i in range(size - k + 1))
            assert Counter(resample.crc_ring(words, n)) == want


@pytest.mark.parametrize(("runs", "buckets", "least", "share"), [(1, 10_000, 20, 10), (3, 997, 5, 35)])
def test_tables(spark, runs, buckets, least, share):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    target = [r[0] for r in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    d, t = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "benchmark"))
    out, names = resample.resample(d, t, runs, buckets, least, share, carry=["doc_id"])
    assert sorted(map(tuple, out.select("doc_id", *names).collect()), key=str) == plain(docs, target, runs, buckets, least, share, 2024)


def test_sql(spark):
    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    got = resample.op11_importance_resampling(spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(duckdb.sql(resample.OP11_SQL).fetchall(), key=str)


def test_edges(spark):
    long = "word " * 60_000
    rows = [(1, "plain words in ONE line", 1, 2), (1, "plain words in ONE line", 1, 2), (2, None, 3, 4), (3, "", 5, 6), (None, "no id é日本 x", None, None), (None, "no id é日本 x", None, None), (4, long, 0, 0), (5, ".,;\n", 0, 0), (1, "other words in this line", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, rank int")
    target = ["plain words", None, "", "line"]
    for share in (0, 50, 100):
        out, (n, weight, score, rank) = resample.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), buckets=100, least=3, share=share)
        assert (score, rank) == ("score_", "rank_") and out.columns == [*docs.columns, n, weight, score, rank]
        got = sorted(map(tuple, out.select("doc_id", n, weight, score, rank).collect()), key=str)
        assert got == plain([r[:2] for r in rows], target, 1, 100, 3, share, 2024)
    none = spark.createDataFrame([], docs.schema)
    assert resample.resample(none, docs)[0].count() == 0
    assert resample.resample(docs, none, least=0)[0].count() == len(rows)


def test_many_equal_rows_are_dealt_out(spark):
    """Rows alike, without ids even, take consecutive ranks."""
    docs = spark.range(3000).selectExpr("cast(null as long) doc_id", "'the same few words' text")
    out = resample.resample(docs, docs.limit(1), least=2, share=50)[0]
    assert sorted(r[0] for r in out.where("rank is not null").select("rank").collect()) == list(range(1, 1501))
