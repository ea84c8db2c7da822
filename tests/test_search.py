import pytest
from pyspark.sql import functions as F

from lodestrata.functions.analyze import postings
from lodestrata.functions.vectors import hash_vector
from lodestrata.operators import search
from lodestrata.operators.graph import expand, expand_sql, relations, rerank_expansion
from lodestrata.plans import answer as A


@pytest.fixture(scope="module")
def emb(spark):
    return spark.createDataFrame([(t, 1, [1.0 if i == k else 0.0 for i in range(4)]) for k, t in enumerate(search.ENTITY_TYPES)], "entity_type string, entity_id long, embedding array<float>")


def ids(df):
    return [(r.entity_type, r.entity_id) for r in df.collect()]


def test_vector(emb):
    q = [1.0, 0.5, 0.2, 0.1]
    assert [t for t, _ in ids(search.vector_topk(emb, q, 10))] == search.ENTITY_TYPES
    assert ids(search.vector_topk(emb, q, 10, {"chunk"})) == [("chunk", 1)]
    assert ids(search.vector_topk(emb, q, 10, set())) == []
    assert len(ids(search.vector_topk(emb, q, 2))) == 2
    with pytest.raises(ValueError, match="dimension 4"):
        search.check_dimension(emb, 384)


@pytest.fixture(scope="module")
def arms(spark):
    rows = [("chunk", 1, "makeblocking", "Run coroutine synchronously in a thread.", "def makeblocking(): pass"), ("commit", 1, "Add bcrypt password hashing to auth", "Add bcrypt password hashing to auth", ""), ("pr", 1, "Add makeblocking helper", "Wraps calls", ""), ("issue", 1, "Passwords not hashed", "plain", "")]
    d = spark.createDataFrame(rows, "entity_type string, entity_id long, a string, b string, d string")
    return {t: postings(d.where(F.col("entity_type") == t), {"a": "A", "b": "B", "d": "D"}) for t in search.ENTITY_TYPES}


def test_lexical(arms):
    assert set(ids(search.lexical_topk(arms, "makeblocking", 10))) == {("chunk", 1), ("pr", 1)}
    assert ids(search.lexical_topk(arms, "bcrypt", 1)) == [("commit", 1)]
    assert ids(search.lexical_topk(arms, "quantum photosynthesis", 5)) == []
    assert ids(search.lexical_topk(arms, "the of", 5)) == []
    assert set(ids(search.lexical_topk(arms, "hashing password", 5, scorer="bm25"))) == {("commit", 1), ("issue", 1)}


def test_cover_density_prefers_close_terms(spark):
    d = spark.createDataFrame([("chunk", 1, "alpha beta"), ("chunk", 2, "alpha x x x x beta"), ("chunk", 3, "alpha")], "entity_type string, entity_id long, d string")
    got = {r.entity_id: r["rank"] for r in search.cover_density(postings(d, {"d": "D"}), ["alpha", "beta"]).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx(0.1) and got[2] == pytest.approx(0.1 / 5)


def test_postings_of_one_search(spark):
    text = "sensibility relational hopping ponies controlled happily national generalizations vietnamization formalize"
    d = spark.createDataFrame([("chunk", 1, text), ("chunk", 2, "other")], "entity_type string, entity_id long, d string")
    whole = postings(d, {"d": "D"}).where("entity_id = 1").collect()
    for r in whole:
        assert postings(d, {"d": "D"}, [r.lexeme]).collect() == [r]


def lists(spark):
    a = spark.createDataFrame([("chunk", 1, 0.9), ("pr", 1, 0.8)], "entity_type string, entity_id long, score double")
    b = spark.createDataFrame([("pr", 1, 5.0), ("chunk", 2, 4.0)], "entity_type string, entity_id long, score double")
    return {"vector": a, "bm25": b}


def test_fusion(spark):
    rows = search.fused_topk(lists(spark), 10).collect()
    assert [(r.entity_type, r.entity_id) for r in rows] == [("pr", 1), ("chunk", 1), ("chunk", 2)]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61) and rows[1].bm25_rank is None and rows[1].vector_rank == 1
    assert ids(search.fused_topk(lists(spark), 10, 6000)) == ids(search.fused_topk(lists(spark), 10, 60))


def test_rerank(spark):
    texts = spark.createDataFrame([("chunk", 2, "key key"), ("pr", 1, "key")], "entity_type string, entity_id long, text string")
    got = search.reranked_topk(search.fused_topk(lists(spark), 10), texts, search.keyword_scorer("key"), 5)
    assert ids(got) == [("chunk", 2), ("pr", 1), ("chunk", 1)]
    assert len(ids(search.reranked_topk(search.fused_topk(lists(spark), 10), texts, search.keyword_scorer("key"), 5, 2))) == 2


E = "repo_id int, source_type string, source_id long, target_type string, target_id long, edge_type string"


def test_expand(spark):
    chain = spark.createDataFrame([(0, "chunk", 1, "commit", 1, "introduced_by"), (0, "commit", 1, "pr", 1, "part_of"), (0, "pr", 1, "issue", 1, "references_issue"), (0, "issue", 1, "pr", 1, "closed_by"), (1, "chunk", 1, "commit", 9, "introduced_by")], E)
    seeds = spark.createDataFrame([("chunk", 1)], "entity_type string, entity_id long")
    assert set(ids(expand(chain, seeds, 0, 2))) == {("commit", 1), ("pr", 1)}
    assert set(ids(expand(chain, seeds, 0, 3))) == {("commit", 1), ("pr", 1), ("issue", 1)}
    chain.createOrReplaceTempView("e")
    seeds.createOrReplaceTempView("s")
    for depth in (1, 2, 3, 5):
        assert sorted(expand(chain, seeds, 0, depth).collect()) == sorted(spark.sql(expand_sql("e", "s", 0, depth)).collect())
    fan = spark.createDataFrame([(0, "chunk", 1, "commit", i, "introduced_by") for i in range(15)], E)
    assert len(ids(expand(fan, seeds, 0, 1, 10))) == 10


def test_expansion_of_more_paths_than_a_recursion_may_hold(spark):
    """40 seeds with 9 paths each of two levels, where Spark lets a recursive query hold 100 rows."""
    fan = [(0, "chunk", s, "commit", 3 * s + i, "introduced_by") for s in range(40) for i in range(3)]
    fan += [(0, "commit", c, "pr", p, "part_of") for c in range(120) for p in range(3)]
    spark.createDataFrame(fan, E).createOrReplaceTempView("e")
    spark.range(40).selectExpr("'chunk' entity_type", "id entity_id").createOrReplaceTempView("s")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        assert len(spark.sql(expand_sql("e", "s", 0, 2, 1000)).collect()) == 123
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_rerank_expansion_and_relations(spark, emb):
    c = spark.createDataFrame([("commit", 1), ("pr", 1), ("pr", 7)], "entity_type string, entity_id long")
    assert ids(rerank_expansion(c, emb, [0.0, 1.0, 0.5, 0.0], 5)) == [("commit", 1), ("pr", 1)]
    edges = spark.createDataFrame([(0, "chunk", 1, "commit", 1, "introduced_by"), (0, "issue", 1, "pr", 1, "closed_by")], E)
    context = spark.createDataFrame([("chunk", 1, "c1"), ("commit", 1, "m1"), ("pr", 1, "p1"), ("issue", 1, "i1")], "entity_type string, entity_id long, display_id string")
    got = {(r.entity_type, r.display_id): r.phrases for r in relations(edges, context).collect()}
    assert got == {("commit", "m1"): "introduced [chunk:c1]", ("issue", "i1"): "closed by [pr:p1]"}


@pytest.fixture(scope="module")
def tables(spark, arms):
    text = {"chunk": "def makeblocking", "commit": "Add bcrypt", "pr": "Add makeblocking helper", "issue": "Passwords not hashed"}
    vec = [(t, 1, [float(x) for x in hash_vector(s, 16)]) for t, s in text.items()]
    row = lambda schema, *v: spark.createDataFrame([v], schema)
    return A.Tables(
        chunks=row("chunk_id long, file_id long, chunk_type string, name string, start_line int, end_line int, content string, language string", 1, 1, "function", "makeblocking", 3, 9, "def makeblocking(): pass", "Python"),
        files=row("file_id long, path string", 1, "a/main.py"),
        commits=row("commit_id long, sha string, message string, author_name string, authored_at timestamp", 1, "a" * 40, "Add bcrypt\n\nmore", None, None),
        prs=row("pr_id long, number int, title string, body string, state string, merged_at timestamp", 1, 234, "Add makeblocking", "b" * 600, "merged", None),
        issues=row("issue_id long, number int, title string, body string, state string, closed_at timestamp", 1, 189, "Hash", None, "open", None),
        edges=spark.createDataFrame([(0, "chunk", 1, "commit", 1, "introduced_by"), (0, "commit", 1, "pr", 1, "part_of"), (0, "pr", 1, "issue", 1, "references_issue")], E),
        embeddings=spark.createDataFrame(vec, "entity_type string, entity_id long, embedding array<double>"),
        postings=arms,
        embed=lambda q: hash_vector(q, 16).tolist(),
        scorer=search.keyword_scorer("makeblocking"),
    )


@pytest.mark.parametrize("mode", ["vector", "bm25", "hybrid", "reranked", "unknown"])
def test_search_modes(tables, mode):
    (r,) = A.search_chunks(tables, "makeblocking", 5, A.Settings(retrieval_mode=mode)).collect()
    assert (r.path, r.display_id, r.rank) == ("a/main.py", "c1", 1)


def test_answer(spark, tables):
    got = A.answer(spark, tables, "why was makeblocking added?")
    assert got.category == "historical_why" and {s["entity_type"] for s in got.sources} == {"chunk", "commit", "pr"}
    assert [(c["display_id"], c["status"]) for c in got.citations] == [("c1", "valid"), ("c999", "invalid"), ("none", "none")]
    assert got.citations[0]["permalink"] == "https://github.com/owner/name/blob/main/a/main.py#L3-L9"
    flat = A.answer(spark, tables, "where is makeblocking")
    assert {s["entity_type"] for s in flat.sources} == {"chunk"}
    assert A.answer(spark, tables, "x", override="out_of_scope").sources == []
    events = [e for e, _ in A.stream_answer(spark, tables, "where is makeblocking")]
    assert events[0] == "sources" and events[-2:] == ["citations", "done"] and events.count("token") > 5
    streamed = list(A.stream_answer(spark, tables, "where is makeblocking"))
    assert "".join(x for e, x in streamed if e == "token") == flat.text and dict(streamed)["citations"] == flat.citations
    assert set(flat.trace["seconds"]) == {"route", "retrieve", "generate"}


class Failing:
    name = "failing"

    def generate(self, messages):
        raise OSError("no answer")

    def stream(self, messages):
        yield "one "
        raise OSError("no answer")


def test_model_errors(spark, tables):
    events = list(A.stream_answer(spark, tables, "where is makeblocking", Failing()))
    assert [e for e, _ in events] == ["sources", "token", "error"] and events[-1][1] == "OSError: no answer"


def test_classifiers(spark):
    from lodestrata.plans import providers

    class Saying:
        name = "saying"

        def __init__(self, text):
            self.text = text

        def generate(self, messages):
            return self.text

    sound = providers.classify_by_model(spark, "where is it", Saying('Sure {"category": "impact", "confidence": 0.5}'))
    assert (sound.category, sound.confidence, sound.method, sound.fallback_used) == ("impact", 0.5, "model:saying", False)
    for model in (Saying("no idea"), Failing()):
        got = providers.classify_by_model(spark, "why was it added", model)
        assert (got.category, got.fallback_used) == ("historical_why", True)
    with pytest.raises(NotImplementedError):
        providers.EMBEDDERS.get("small")
    with pytest.raises(ValueError, match="unknown embedder"):
        providers.EMBEDDERS.get("other")
    assert len(providers.EMBEDDERS.get("hashing", dimension=8).vector(spark, "a b")) == 8


def test_limiter_is_shared():
    assert A.pacer(7) is A.pacer(7)


def test_settings_from_environment():
    s = A.Settings.from_env({"LODESTRATA_RRF_K": "7", "LODESTRATA_MODEL": "x", "OTHER": "1"})
    assert (s.rrf_k, s.model, s.top_k) == (7, "x", 5)


def test_repository_scope(spark):
    """Rows of another repository neither count nor displace."""
    e = spark.createDataFrame([(0, "chunk", 1, [1.0, 0.0]), (1, "chunk", 1, [1.0, 0.1]), (1, "chunk", 2, [0.0, 1.0])], "repo_id long, entity_type string, entity_id long, embedding array<double>")
    assert [r.entity_id for r in search.vector_topk(e, [1.0, 0.1], 5, repo_id=1).collect()] == [1, 2]
    assert search.vector_topk(e, [1.0, 0.1], 5, repo_id=2).count() == 0
    p = spark.createDataFrame([(0, "chunk", 1, "x", 1, "D"), (1, "chunk", 5, "x", 1, "D")], "repo_id long, entity_type string, entity_id long, lexeme string, pos int, weight string")
    assert [r.entity_id for r in search.lexical_topk({"chunk": p}, "x", 5, repo_id=1).collect()] == [5]


def test_limits():
    clock = [0.0]
    pacer = A.Pacer(2, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    for _ in range(5):
        pacer.wait()
    assert clock[0] == 120.0
    A.Pacer(0, sleep=lambda s: pytest.fail("no limit")).wait()


def test_limits_of_threads():
    """Sixteen calls from eight threads: never more than four starts within a minute."""
    import threading

    lock, starts, slept = threading.Lock(), [], []
    pacer = A.Pacer(4, lambda: 0.0, slept.append)

    def call():
        for _ in range(2):
            pacer.wait()
            with lock:
                starts.append(1)

    threads = [threading.Thread(target=call) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(starts) == 16 and sorted(slept) == [60.0] * 4 + [120.0] * 4 + [180.0] * 4


def test_settings():
    with pytest.raises(ValueError, match="rrf_k"):
        A.Settings(rrf_k=0)


def test_index(spark):
    """Recall of the index against exact search."""
    from lodestrata.operators.index import build_index, indexed_topk
    from lodestrata.plans.adapters import embeddings

    e = embeddings(spark, "/root/testdata/sf0.001").cache()
    model, indexed = build_index(e)
    indexed = indexed.cache()
    found = total = 0
    for r in e.where("entity_id % 100 = 0").collect():
        exact = {(x.entity_type, x.entity_id) for x in search.vector_topk(e, r.embedding, 10).collect()}
        got = {(x.entity_type, x.entity_id) for x in indexed_topk(model, indexed, r.embedding, 10).collect()}
        found, total = found + len(exact & got), total + len(exact)
    assert found / total >= 0.9
    assert all(t == "pr" for t, _ in ids(indexed_topk(model, indexed, r.embedding, 5, {"pr"})))
    e.unpersist()
    indexed.unpersist()
