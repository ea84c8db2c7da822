"""Block postings: bounds that hold, answers as without blocks, and fewer blocks read than there are."""

import random
from functools import reduce

import pytest
from lodestrata.functions.analyze import lengths as lengths_of
from lodestrata.functions.analyze import packed, postings
from lodestrata.operators import blocks as B
from lodestrata.operators import search
from lodestrata.plans import adapters as A
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """3000 texts of a few frequent words, in blocks of some ten."""
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", f"w{i}"], [1, 1, rng.random() * 6, 2, 8], k=rng.randrange(1, 60)))) for i in range(3000)]
    # some of many covers
    texts = [(i, "alpha gamma " * 30 if i % 500 == 0 else t) for i, t in texts]
    docs = spark.createDataFrame(texts, "entity_id long, d string").selectExpr("if(entity_id % 3 = 0, 'pr', 'chunk') entity_type", "entity_id", "if(entity_id % 7 = 0, 'gamma head', '') a", "d")
    rows = postings(docs, {"a": "A", "d": "D"}).withColumn("repo_id", F.lit(1).cast("long")).cache()
    lengths = rows.groupBy("repo_id", "entity_type", "entity_id").agg(F.count("*").alias("len"))
    path = str(tmp_path_factory.mktemp("blocks") / "block")
    B.write_blocks(B.block_postings(rows, lengths, per_block=10), path, 4)
    return rows, B.BlockIndex(spark.read.schema(B.SCHEMA).parquet(path), lengths)


def answer(df):
    return [(r.entity_type, r.entity_id, round(r.score, 9)) for r in df.collect()]


def test_unpacked_is_what_was_packed(index):
    rows, blocks = index
    cols = ["entity_type", "entity_id", "lexeme", "pos", "weight"]
    assert sorted(map(tuple, B.unpacked(blocks.blocks).collect())) == sorted(map(tuple, rows.select(cols).collect()))


@pytest.mark.parametrize("query", ["gamma", "alpha", "alpha beta", "gamma alpha delta", "absent", "gamma absent", "the"])
@pytest.mark.parametrize("types", [None, {"pr"}, set()])
def test_same_answers(index, query, types):
    rows, blocks = index
    arms = {t: rows.where(F.col("entity_type") == t) for t in ("chunk", "pr")}
    for scorer in ("cover", "bm25"):
        want = answer(search.lexical_topk(arms, query, 15, types, scorer=scorer))
        assert answer(search.lexical_topk(blocks, query, 15, types, scorer=scorer)) == want
    assert answer(search.lexical_topk(blocks, query, 15, types, repo_id=2)) == []


@pytest.mark.parametrize("lexemes", [["gamma"], ["alpha", "gamma"]])
def test_bounds_hold_and_skip(index, lexemes):
    """No entity scores above its block's bound; a top-k reads a part of the blocks."""
    _, blocks = index
    held = blocks.blocks.where(F.col("lexeme").isin(lexemes))
    bound = {(r.entity_type, r.block): r.bound for r in B.bounds(held, lexemes).collect()}
    where = {(r.entity_type, r.e): r.block for r in held.select("entity_type", "block", F.explode("entities.entity_id").alias("e")).distinct().collect()}
    for r in search.cover_density(B.unpacked(held), lexemes).collect():
        assert r["rank"] <= bound[r.entity_type, where[r.entity_type, r.entity_id]] + 1e-9
    all_of_them, _ = search.bounded_topk(held, lexemes, 5, steps=())
    found, read = search.bounded_topk(held, lexemes, 5, steps=(16, 64, 128))
    assert answer(found) == answer(all_of_them) and read is not None and read < len(bound)


def test_ties_are_never_cut_off(spark):
    """Where every entity scores alike all blocks are read, and the smallest ids win."""
    docs = spark.range(200).selectExpr("'chunk' entity_type", "id entity_id", "'quartz' d")
    rows = postings(docs, {"d": "D"}).withColumn("repo_id", F.lit(0).cast("long"))
    lengths = rows.groupBy("repo_id", "entity_type", "entity_id").agg(F.count("*").alias("len"))
    held = B.block_postings(rows, lengths, per_block=10)
    found, read = search.bounded_topk(held, ["quartz"], 4, steps=(2, 5))
    assert read is None and [r.entity_id for r in found.collect()] == [0, 1, 2, 3]


def test_blocks_from_packed_rows(spark, tmp_path):
    """They are those of the postings, of entities in two rows and without a word too, and no token is a row, nor shuffled."""
    rng = random.Random(5)
    texts = [(i % 290, " ".join(rng.choices(["running", "runs", "the", "ski", "Skies", "\u00c4rger", f"w{i}"], k=rng.randrange(40)))) for i in range(300)]
    docs = spark.createDataFrame([*texts, (500, None), (501, "the")], "entity_id long, d string").selectExpr("if(entity_id % 3 = 0, 'pr', 'chunk') entity_type", "entity_id", "if(entity_id % 7 = 0, 'ski run', '') a", "d").repartition(3)
    segments = {"a": "A", "d": "D"}
    rows = postings(docs, segments).withColumn("repo_id", F.lit(4).cast("long"))
    lengths = rows.groupBy("repo_id", "entity_type", "entity_id").agg(F.count("*").alias("len"))
    assert sorted(map(tuple, lengths_of(docs, segments).collect())) == sorted(map(tuple, lengths.drop("repo_id").collect()))
    each = packed(docs, segments)
    assert each.count() < rows.count() / 2 and "hashpartitioning" not in each._jdf.queryExecution().toString()
    path = str(tmp_path / "block")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        B.write_packed(each, lengths, path, 3, 4, per_block=10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got, want = spark.read.schema(B.SCHEMA).parquet(path), B.block_postings(rows, lengths, per_block=10)
    whole = lambda df: sorted((r.repo_id, r.entity_type, r.lexeme, r.block, r.n, round(r.best, 9), r.most, r.top, [(e.entity_id, sorted(zip(e["at"], e.marks))) for e in r.entities]) for r in df.collect())
    assert whole(got) == whole(want)


def whole(df):
    """What an index holds of each entity, whatever its block."""
    each = df.select("repo_id", "entity_type", "lexeme", F.explode("entities").alias("e")).collect()
    return sorted((r.repo_id, r.entity_type, r.lexeme, str(r.e.entity_id), sorted(zip(r.e["at"], r.e.marks))) for r in each)


def test_blocks_of_entities_where_they_are_read(spark, tmp_path, monkeypatch):
    """Without a shuffle or sort: the same postings and lengths, an entity in one block, bounds that hold; of mixed types, small runs and no id too."""
    rng = random.Random(6)
    texts = [(i if i else None, " ".join(rng.choices(["running", "runs", "the", "ski", "Skies", "Ärger", f"w{i}"], k=rng.randrange(40)))) for i in range(300)]
    docs = spark.createDataFrame([*texts, (500, None), (501, "the")], "entity_id long, d string").selectExpr("if(entity_id % 3 = 0, 'pr', 'chunk') entity_type", "entity_id", "if(entity_id % 7 = 0, 'ski run', '') a", "d").repartition(3)
    segments = {"a": "A", "d": "D"}
    rows = postings(docs, segments).withColumn("repo_id", F.lit(4).cast("long"))
    lengths = rows.groupBy("repo_id", "entity_type", "entity_id").agg(F.count("*").alias("len"))
    monkeypatch.setattr(B, "RUN", 2000)
    path = str(tmp_path / "block")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        B.write_entities(docs, segments, path, 4, per_block=10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.schema(f"{B.SCHEMA}, {B.OWN}").parquet(path).cache()
    assert whole(got) == whole(B.block_postings(rows, lengths, per_block=10))
    assert got.groupBy("entity_type", "lexeme", "block").count().where("count > 1").isEmpty()
    own = got.select("repo_id", "entity_type", F.explode("own").alias("o")).select("repo_id", "entity_type", "o.*").collect()
    assert sorted(map(str, map(tuple, own))) == sorted(map(str, map(tuple, lengths.collect())))
    each = got.select("entity_type", "block", F.explode("entities.entity_id").alias("e")).distinct().cache()
    assert each.groupBy("entity_type", "e").count().where("count > 1").isEmpty()
    assert each.groupBy("block").count().agg(F.max("count")).first()[0] <= 10
    lexemes = ["run", "ski"]
    bound = {(r.entity_type, r.block): r.bound for r in B.bounds(got, lexemes).collect()}
    where = {(r.entity_type, r.e): r.block for r in each.collect()}
    ranks = search.cover_density(B.unpacked(got), lexemes).collect()
    assert ranks and all(r["rank"] <= bound[r.entity_type, where[r.entity_type, r.entity_id]] + 1e-9 for r in ranks)


def shuffled(spark):
    """Bytes that each stage has written to a shuffle."""
    context = spark.sparkContext._jsc.sc()
    # figures come after the stage
    context.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = context.statusStore().stageList(None, False, False, none, None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


@pytest.mark.parametrize("repeated", [False, True])
def test_the_build_shuffles_less_than_the_texts(spark, tmp_path, repeated):
    """Ids in several rows are one entity, and are all that meets in a shuffle."""
    rng = random.Random(7)
    texts = [(i, f"src{i % 5}", " ".join(f"w{rng.randrange(3000)}" for _ in range(300))) for i in range(1000)]
    texts += [(3, "src3", "w1 w2"), (None, "src9", "w1 w1"), (None, "src9", "w2")] if repeated else []
    tables = {
        "documents": spark.createDataFrame(texts, "doc_id long, source string, text string"),
        "conversations": spark.createDataFrame([(1, 0, "first line\nw1 again")], "conv_id long, turn int, text string"),
        "pages": spark.createDataFrame([(1, "http://x/y", "<title>w2</title> page")], "page_id long, url string, html string"),
        "benchmark": spark.createDataFrame([(1, "w3 item")], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    before = set(shuffled(spark))
    index = A.index(spark, str(tmp_path))
    written = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert written < sum(len(t) for _, _, t in texts) / 20
    entities = reduce(lambda a, b: a.unionByName(b), A.arms(spark, str(tmp_path)).values())
    rows = postings(entities, {"a": "A", "b": "B", "d": "D"}).withColumn("repo_id", F.lit(0).cast("long"))
    lengths = rows.groupBy("repo_id", "entity_type", "entity_id").agg(F.count("*").alias("len"))
    assert whole(index.blocks) == whole(B.block_postings(rows, lengths))
    assert sorted(map(str, map(tuple, index.lengths.collect()))) == sorted(map(str, map(tuple, lengths.collect())))
