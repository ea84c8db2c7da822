"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import common, embeddings, labelled, lines, mixing, packing, pii, quality, rules, simhash, tokenfile, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, __t string, __d long, __h long, __id long, shard int, size long, key string, spans string"
LONG = "word " * 60_000
ROWS = [
    (1, "some words stand here for once and all of them are quite plain", "en", "a", 62),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", "b", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, "twice is twice\nsecond line of it", "en", "a", 32),
    (6, "twice is twice\nsecond line of it", "en", "a", 32),
    (7, "twice is twice\nsecond line of it", "de", "b", 32),
    (7, "other text with the same number of words yes", "en", "b", 44),
    (None, "no id here but words", "en", None, 20),
    (8, "1" * 50_000 + " a@b.co é😀 +1 (907) 555-1190", "en", "c", None),
    (9, "twice is twice\nsecond line of it\nand another", "en", "c", 44),
]


@pytest.fixture(scope="module", params=["full", "empty"])
def docs(spark, request):
    rows = [(*r, 1, "t", 2, 3, 4, 5, 6, "k", "s") for r in ROWS] if request.param == "full" else []
    return spark.createDataFrame(rows, SCHEMA)


LEXICON = toxicity.Lexicon({"idiot": 1.0, "scum": 1.0})
MODEL = quality.fit(np.zeros((0, quality.FEATURES), np.float32), np.zeros(0))


def test_row_per_row(spark, docs, tmp_path):
    n = docs.count()
    to = str(tmp_path / "tokens")
    for got in (
        tokenfile.read_token_files(tokenfile.write_token_files(docs, to), to),
        simhash.simhash_groups(docs),
        lines.dedup_lines(docs)[0],
        toxicity.score_toxicity(docs, LEXICON),
        mixing.mixing_plan(docs),
        pii.pii_spans(docs),
        quality.score_quality(docs, MODEL),
        rules.judge(docs, rules.ratios(np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS))),
    ):
        assert got.count() == n, got.columns
    pieces = packing.pack(packing.tokenize_pieces(docs)).toPandas()
    assert len(pieces) >= n and (pieces.groupby("sequence_id").length.sum() <= 4096).all()


def test_stages(spark, docs, tmp_path):
    kept = docs
    (labels := spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert labels.count() == 1
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    assert bool(kept.count()) == bool(docs.count())
    if docs.count():
        near = {r.doc_id for r in spark.read.parquet(str(tmp_path / "simhash_dedup")).select("doc_id").collect()}
        assert {1, 5, 8} <= near and len({2, 3, 4} & near) == 1


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.001], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (None, [1.0, 0.0], 1), (10, [0.0, 1.0], 1), (11, [1.0, 0.0], 2), (12, [1.0], 1), (13, [], 1)]
    got = embeddings.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")).collect()
    assert len(got) == len(rows)
    by = [(r.vec_id, r.n_links, r.component_id) for r in got]
    assert sorted(x for x in by if x[0] in (1, 2, 3)) == [(1, 4, 1), (2, 4, 1), (2, 4, 1), (3, 4, 1)]
    assert all(x[1:] == (0, x[0]) for x in by if x[0] in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13))
    assert (None, 4, 1) in by
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(empty).count() == 0


def test_dense_vectors(spark):
    """One label with many near copies, over several tiles and cells, against brute force."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    v = np.concatenate([base[i % 40] + rng.normal(scale=0.08, size=8) for i in range(600)]).reshape(-1, 8)
    v[::7] = v[0]
    got = embeddings.near_vectors(spark.createDataFrame([(i, x.tolist(), "l") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label string"), tile=32).toPandas().sort_values("vec_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    assert got.n_links.tolist() == near.sum(1).tolist()
    root = np.arange(len(v))
    while True:
        new = np.where(near, root, len(v)).min(1).clip(max=root)
        if (new == root).all():
            break
        root = new
    assert got.component_id.tolist() == root.tolist()


def test_covering():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    rng = np.random.default_rng(0)
    for _ in range(500):
        bits = rng.choice(64, 4, replace=False)
        assert any(not any(m >> int(b) & 1 for b in bits) for m in masks)


def test_large_buckets(spark):
    """Buckets over several tiles and batches: chains that link every fingerprint, and far ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        rng = np.random.default_rng(3)
        dense = [int(x) for x in rng.integers(0, 1 << 8, 120)]  # few bits: most within the radius
        far = [int(x) << 20 for x in rng.integers(1, 1 << 40, 80)]
        fps = sorted(set(dense + far))
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=8)
        got = {r.node: r.component for r in common.components(links).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a = np.array(signed, np.int64).view(np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    root = np.arange(len(a))
    while True:
        new = np.where(near, root, len(a)).min(1)
        if (new == root).all():
            break
        root = new
    groups, want = {}, {}
    for f, r in zip(signed, root):
        groups.setdefault(got.get(f, f), set()).add(f)
        want.setdefault(int(r), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_span_hashes(monkeypatch):
    """The same whatever the block, also for spans over several blocks; different for different bytes."""
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    cut = np.unique(np.r_[0, rng.integers(0, 5000, 40), 3000, 5000])
    whole = common.span_hashes(data, cut[:-1], cut[1:])
    for block in (7, 64, 999):
        monkeypatch.setattr(common, "_BLOCK", block)
        assert (common.span_hashes(data, cut[:-1], cut[1:]) == whole).all()
    twice = np.r_[data[:100], data[:100], data[:99], [data[99] ^ 1]].astype(np.uint8)
    a, b, c = common.span_hashes(twice, np.array([0, 100, 200]), np.array([100, 200, 300]))
    assert a == b != c and len(set(whole)) == len(whole)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_file_random_access():
    rng = np.random.default_rng(0)
    ids = rng.choice([3, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], 5000).astype(np.uint32)
    f = tokenfile.DacFile(tokenfile.encode_dac([5, None, 9], np.array([4000, 0, 1000]), ids))
    assert [f[i] for i in range(0, 5000, 37)] == ids[::37].tolist()
    assert (f.slice(100, 3333) == ids[100:3333]).all() and (f.document(2) == ids[4000:]).all() and len(f.document(1)) == 0
    assert f.doc_ids == [5, None, 9]
    with pytest.raises(IndexError):
        f[5000]
    empty = tokenfile.DacFile(tokenfile.encode_dac([1], np.array([0]), np.zeros(0, np.uint32)))
    assert len(empty.document(0)) == 0


def test_shared_passages(spark):
    """A passage of several lines in other documents is found whatever stands before it, and the first place keeps it."""
    rng = np.random.default_rng(5)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 18))
    passage = [line() for _ in range(4)]
    rows = [(i, "\n".join([line() for _ in range(i % 5)] + passage + [line() for _ in range(i % 3)])) for i in range(30)] + [(100 + i, "\n".join(line() for _ in range(6))) for i in range(30)]
    out, left, chunks, words = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in out.collect()}
    for i, text in rows:
        want = text if i == 0 or i >= 100 else "\n".join(x for x in text.split("\n") if x not in passage)
        assert got[i][left] == want
    assert got[3][words] == 72


def test_line_dedup_single_long_line(spark):
    long = " ".join(f"w{i}" for i in range(60))
    out, left, *_ = lines.dedup_lines(spark.createDataFrame([(1, f"a\n{long}"), (2, f"b\n{long}\nc"), (3, "short\nx"), (4, "short\ny")], "doc_id long, text string"))
    assert {r.doc_id: r[left] for r in out.collect()} == {1: f"a\n{long}", 2: "b\nc", 3: "short\nx", 4: "short\ny"}


@pytest.mark.parametrize("text, toxic", [("you are an idiot and scum " + "x " * 20, True), ("you are an 1d1ot and sсum " + "x " * 20, True), ("IDIOT!!! SCUM###", True), ("an idiotic scumble", False), ("", False)])
def test_folding(text, toxic):
    lexicon = toxicity.Lexicon({"idiot": 1.0, "scum": 1.0}, bias=-3.0, slope=3.0)
    assert (lexicon.score(text) >= 0.5) == toxic


def test_exception_phrases():
    lexicon = toxicity.Lexicon({"trash": 1.0}, ("trash can", "trash bin"), bias=-2.0, slope=5.0)
    assert lexicon.score("put it in the trash can") < 0.5 < lexicon.score("you are trash")


def test_mixing_takes_budgets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "s0" if i % 3 else "s1") for i in range(300)], "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit("en"))
    plan = mixing.mixing_plan(docs).toPandas()
    for _, g in plan.groupby("source"):
        assert g.taken.sum() == round(g.target.iloc[0])
    out = corpus_pipeline.mix_sources(spark, docs, "")
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {s: round(g.target.iloc[0]) for s, g in plan.groupby("source")}


def test_held_out(spark):
    rows = spark.range(50).select("id", labelled.held_out("id").alias("h")).collect()
    assert all(r.h == labelled.is_held_out(r.id) for r in rows)
