"""Retrieval: vector, lexical, fused and reranked top-k, each as pointers (entity_type, entity_id, score, ...)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.analyze import query_lexemes
from lodestrata.functions.vectors import cosine, vector
from lodestrata.operators import blocks as B

ENTITY_TYPES = ["chunk", "commit", "pr", "issue"]
KEYS = ["entity_type", "entity_id"]


def of_types(df: DataFrame, types: set[str] | None) -> DataFrame:
    """None: any type. An empty set: no row."""
    if types is None:
        return df
    return df.where(F.col("entity_type").isin(*sorted(types))) if types else df.limit(0)


def of_repo(df: DataFrame, repo_id: int | None) -> DataFrame:
    """None: any repository."""
    return df if repo_id is None else df.where(F.col("repo_id") == repo_id)


def check_dimension(embeddings: DataFrame, dim: int) -> None:
    """Refuse embeddings of another size; one row is read."""
    wrong = embeddings.where(F.size("embedding") != dim).limit(1).select(F.size("embedding")).first()
    if wrong:
        raise ValueError(f"stored dimension {wrong[0]}, expected {dim}")


def vector_topk(embeddings: DataFrame, query, k: int, types: set[str] | None = None, live: DataFrame | None = None, repo_id: int | None = None) -> DataFrame:
    """The k nearest by cosine, exactly. live: (entity_type, entity_id) that still exist; others don't count towards k.

    repo_id: only embeddings of this repository.
    """
    rows = of_repo(of_types(embeddings, types), repo_id)
    if live is not None:
        rows = rows.join(live.select(*KEYS), KEYS, "left_semi")
    sim = cosine(F.col("embedding"), vector(query))
    return rows.select(*KEYS, sim.alias("score")).where("score is not null").withColumn("distance", 1 - F.col("score")).orderBy(F.desc("score"), *KEYS).limit(k)


def matches(postings: DataFrame, lexemes: list[str]) -> DataFrame:
    """Postings of the entities that hold every lexeme. The filter on lexemes comes first, so a scan sorted by it skips files."""
    hit = postings.where(F.col("lexeme").isin(lexemes))
    if len(lexemes) == 1:
        return hit
    whole = hit.groupBy(*KEYS).agg(F.count_distinct("lexeme").alias("n")).where(F.col("n") == len(lexemes))
    return hit.join(whole.select(*KEYS), KEYS, "left_semi")


def cover_density(postings: DataFrame, lexemes: list[str]) -> DataFrame:
    """Cover density (Clarke, Cormack, Tudhope 2000) of each matching entity.

    A cover is a shortest stretch that holds every lexeme; it adds the harmonic mean of its weights over one plus the number of
    other tokens inside it. A single lexeme: the sum of its weights.
    """
    hit = matches(postings, lexemes).withColumn("w", B.weight_of(F.col("weight")))
    if len(lexemes) == 1:
        # by counts of each weight, so that the sum doesn't depend on the order of rows
        each = [F.count_if(F.col("weight") == letter) * F.lit(w) for letter, w in B.WEIGHTS.items()]
        return hit.groupBy(*KEYS).agg(reduce(lambda a, b: a + b, each).alias("rank"))
    here = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = {f"_{i}": F.max(F.when(F.col("lexeme") == x, F.struct("pos", "w"))).over(here) for i, x in enumerate(lexemes)}
    last = hit.withColumns(seen)
    starts = F.array(*[F.col(f"_{i}.pos") for i in range(len(lexemes))])
    last = last.where(reduce(lambda a, b: a & b, [F.col(f"_{i}").isNotNull() for i in range(len(lexemes))])).withColumn("begin", F.array_min(starts))
    # of the stretches that begin at one place the first to end is the shortest
    inverse = reduce(lambda a, b: a + b, [1 / F.col(f"_{i}.w") for i in range(len(lexemes))])
    covers = last.groupBy(*KEYS, "begin").agg(F.min(F.struct(F.col("pos").alias("end"), inverse.alias("inv"))).alias("c"))
    noise = F.greatest(F.col("c.end") - F.col("begin") - (len(lexemes) - 1), F.lit(0))
    return covers.groupBy(*KEYS).agg(F.sum(len(lexemes) / F.col("c.inv") / (1 + noise)).alias("rank"))


def okapi(postings: DataFrame, lexemes: list[str], k1: float = 1.2, b: float = 0.75, lengths: DataFrame | None = None) -> DataFrame:
    """BM25 as published (Robertson and Zaragoza 2009), over entities that hold every lexeme.

    lengths: keys and `len`, the number of an entity's postings, where it is kept; else it is counted from all postings.
    """
    lengths = postings.groupBy(*KEYS).agg(F.count("*").alias("len")) if lengths is None else lengths
    n, mean = lengths.agg(F.count("*"), F.avg("len")).first()
    hit = postings.where(F.col("lexeme").isin(lexemes)).groupBy(*KEYS, "lexeme").agg(F.count("*").alias("tf"))
    df = hit.groupBy("lexeme").agg(F.count("*").alias("df"))
    # a row for each of the query's lexemes
    scored = hit.join(F.broadcast(df), "lexeme").join(lengths, KEYS)
    idf = F.log((F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(mean or 1))))
    return scored.groupBy(*KEYS).agg(F.sum(part).alias("rank"), F.count("*").alias("n")).where(F.col("n") == len(lexemes)).drop("n")


def _best(ranked: DataFrame, k: int, norm: str) -> DataFrame:
    score = F.col("rank") / (F.col("rank") + 1) if norm == "saturate" else F.col("rank")
    # sums of the same parts in another order are no difference
    return ranked.select(*KEYS, score.alias("score")).orderBy(F.desc(F.round("score", 12)), *KEYS).limit(k)


def lexical_topk(arms: dict[str, DataFrame] | B.BlockIndex, query: str, k: int, types: set[str] | None = None, scorer: str = "cover",
    norm: str = "saturate", repo_id: int | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """The k best of the union of typed arms (postings by entity type); arms of other types are never planned. arms: or an index of blocks.

    norm: "saturate" is rank / (rank + 1), "none" the rank itself. A query without a searchable word finds nothing.
    repo_id: only postings of this repository; ids of entities are unique within one. lengths: see okapi.
    """
    lexemes = query_lexemes(query)
    if isinstance(arms, B.BlockIndex):
        return _indexed_topk(arms, lexemes, k, types, scorer, norm, repo_id)
    chosen = [df for t, df in arms.items() if types is None or t in types]
    if not chosen or not lexemes:
        return next(iter(arms.values())).select(*KEYS, F.lit(0.0).alias("score")).limit(0)
    union = of_repo(reduce(DataFrame.unionByName, chosen), repo_id)
    return _best(okapi(union, lexemes, lengths=lengths) if scorer == "bm25" else cover_density(union, lexemes), k, norm)


def _indexed_topk(index: B.BlockIndex, lexemes: list[str], k: int, types: set[str] | None, scorer: str, norm: str, repo_id: int | None) -> DataFrame:
    rows = index.of(types, repo_id)
    if not lexemes or types == set():
        return rows.select("entity_type", F.col("block").alias("entity_id"), F.lit(0.0).alias("score")).limit(0)
    held = rows.where(F.col("lexeme").isin(lexemes))
    if scorer == "bm25":
        own = of_repo(of_types(index.lengths, types), repo_id)
        return _best(okapi(B.unpacked(held), lexemes, lengths=own), k, norm)
    return bounded_topk(held, lexemes, k, norm)[0]


def bounded_topk(held: DataFrame, lexemes: list[str], k: int, norm: str = "saturate", steps: tuple[int, ...] = B.STEPS) -> tuple[DataFrame, int | None]:
    """(the k best by cover density, blocks read; None: all) of the blocks of some lexemes.

    Blocks are read in order of their bounds, some at first and then more, until the k-th best so far is above the bound of
    all that is left; where the last step doesn't suffice all are read. k rows and the bounds of a step reach the driver.
    """
    bound = B.bounds(held, lexemes)
    for n in steps:
        chosen, left = B.first_blocks(bound, n)
        if left is None:
            break
        part = held.join(F.broadcast(chosen.select("repo_id", "entity_type", "block")), ["repo_id", "entity_type", "block"], "left_semi")
        found = _best(cover_density(B.unpacked(part), lexemes), k, "none")
        rows = found.collect()
        if len(rows) == k and rows[-1].score > left * (1 + 1e-9):
            score = F.col("score") / (F.col("score") + 1) if norm == "saturate" else F.col("score")
            return held.sparkSession.createDataFrame(rows, found.schema).select(*KEYS, score.alias("score")), n
    return _best(cover_density(B.unpacked(held), lexemes), k, norm), None


def ranked(pointers: DataFrame) -> DataFrame:
    """A rank from 1 over a top-k that is already cut: the window sees k rows."""
    return pointers.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *KEYS)))


def reciprocal_rank_fusion(lists: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists that hold an entity; ties keep the order of first sight.

    A union and one aggregate instead of outer joins. Columns: keys, score, and <name>_rank of each list.
    """
    tagged = [ranked(df).select(*KEYS, F.lit(name).alias("list"), F.lit(i).alias("nth"), "rank") for i, (name, df) in enumerate(lists.items())]
    both = reduce(DataFrame.unionByName, tagged)
    ranks = [F.max(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists]
    return both.groupBy(*KEYS).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"), F.min(F.struct("nth", "rank")).alias("seen"), *ranks)


def fused_topk(lists: dict[str, DataFrame], top: int, k: int = 60) -> DataFrame:
    return reciprocal_rank_fusion(lists, k).orderBy(F.desc("score"), "seen").limit(top)


def hybrid_topk(embeddings: DataFrame, arms: dict[str, DataFrame], query: str, query_vector, k: int, types: set[str] | None = None, candidates: int = 50, rrf_k: int = 60, repo_id: int | None = None) -> DataFrame:
    """Both retrievers' candidates under the same filters, fused."""
    near = vector_topk(embeddings, query_vector, candidates, types, repo_id=repo_id)
    found = lexical_topk(arms, query, candidates, types, repo_id=repo_id)
    return fused_topk({"vector": near, "bm25": found}, k, rrf_k)


def keyword_scorer(keyword: str) -> Callable[[Column], Column]:
    """A stand-in for a cross-encoder: how often the keyword occurs."""
    return lambda text: F.regexp_count(F.lower(text), F.lit(f"\\Q{keyword.lower()}\\E")).cast("double")


def reranked_topk(inner: DataFrame, texts: DataFrame, scorer: Callable[[Column], Column], k: int, input_n: int = 20) -> DataFrame:
    """The first input_n of a retriever's pointers in a second scorer's order; ties keep the inner one's.

    texts: keys and text; a pointer without a text is scored on "". scorer: a column expression or pandas UDF.
    """
    first = inner.orderBy(F.desc("score"), *KEYS).limit(input_n)
    first = ranked(first).withColumnRenamed("rank", "inner_rank")
    # at most input_n rows
    found = texts.select(*KEYS, "text").join(F.broadcast(first.select(*KEYS)), KEYS, "left_semi")
    scored = first.join(found, KEYS, "left").withColumn("rerank_score", scorer(F.coalesce("text", F.lit(""))))
    return scored.orderBy(F.desc("rerank_score"), "inner_rank").limit(k).drop("text")


def hydrate(pointers: DataFrame, entities: DataFrame) -> DataFrame:
    """Pointers joined to their rows, in pointer order and numbered; pointers without a row go. k rows are broadcast."""
    number = F.row_number().over(Window.orderBy("rank"))
    return F.broadcast(ranked(pointers)).join(entities, KEYS).withColumn("display", number)
