"""From a question to a checked answer: routing, retrieval, context, generation, citations."""

from __future__ import annotations

import functools
import math
import os
import re
import threading
import time
import warnings
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, fields
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import error_text, ref_of, rerank_text
from lodestrata.operators import citations, graph, search
from lodestrata.operators.blocks import BlockIndex
from lodestrata.plans.providers import MODELS, classify_by_keyword, classify_by_model


@dataclass
class Settings:
    retrieval_mode: str = "hybrid"
    rrf_k: int = 60
    candidates: int = 50
    input_n: int = 20
    top_k: int = 5
    max_depth: int = 2
    max_breadth: int = 10
    history_months: int = 12
    requests_per_minute: int = 0
    embedder: str = "hashing"
    model: str = "canned"
    model_name: str = ""
    model_url: str = ""
    model_key: str = field(default="", repr=False)
    classifier: str = "keyword"
    history_token: str = field(default="", repr=False)
    store: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "LODESTRATA_") -> Settings:
        """Each field from the variable of its name in capitals, where there is one."""
        found = {f.name: env[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in env}
        return cls(**{k: type(getattr(cls, k, ""))(v) for k, v in found.items()})

    def __post_init__(self) -> None:
        for k in ("rrf_k", "candidates", "input_n", "top_k"):
            if getattr(self, k) < 1:
                raise ValueError(f"{k} is 1 or more")
        if not 1 <= self.history_months <= 120:
            raise ValueError("history_months is 1 to 120")


@dataclass
class Tables:
    """The tables of a repository: of tables that hold several, its own rows, since ids of entities are unique within one alone.

    embed: text -> vector, on the driver, for one question. postings: by entity type, or an index of blocks.
    """

    chunks: DataFrame
    files: DataFrame
    commits: DataFrame
    prs: DataFrame
    issues: DataFrame
    edges: DataFrame
    embeddings: DataFrame
    postings: dict[str, DataFrame] | BlockIndex
    embed: Callable[[str], list[float]]
    scorer: Callable | None = None
    owner: str = "owner"
    name: str = "name"
    sha: str | None = None
    branch: str = "main"
    repo_id: int = 0

    def __post_init__(self) -> None:
        own = lambda df: df.where(F.col("repo_id") == self.repo_id) if "repo_id" in df.columns else df
        for table in ("chunks", "files", "commits", "prs", "issues", "edges", "embeddings"):
            setattr(self, table, own(getattr(self, table)))
        if isinstance(self.postings, BlockIndex):
            self.postings = BlockIndex(own(self.postings.blocks), own(self.postings.lengths))
        else:
            self.postings = {k: own(p) for k, p in self.postings.items()}


class Pacer:
    """Start times for calls, `per_minute` in any 60 seconds; 0 or less: at once.

    A ring holds the last `per_minute` starts; a call takes the place of the oldest and starts 60 seconds after it at the
    earliest. Places are given under a lock, waiting is done outside it.
    """

    def __init__(self, per_minute: int, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.now, self.sleep, self.lock = now, sleep, threading.Lock()
        self.starts, self.given = [-math.inf] * max(per_minute, 0), 0

    def wait(self) -> None:
        if not self.starts:
            return
        with self.lock:
            place = self.given % len(self.starts)
            self.given += 1
            self.starts[place] = start = max(self.now(), self.starts[place] + 60)
        if (left := start - self.now()) > 0:
            self.sleep(left)


class CannedModel:
    """A model for tests: it cites the first excerpt that it is shown, then one that it isn't, then none."""

    name = "canned"

    def generate(self, messages: list[dict]) -> str:
        shown = re.search(r"(?m)^\[([a-z]\d+)\] (code|commit|pr|issue):", messages[-1]["content"] if messages else "")
        known = ""
        if shown:
            kind = {"code": "chunk"}.get(shown.group(2), shown.group(2))
            known = f"Excerpt {shown.group(1)} bears on this [{kind}:{shown.group(1)}]. "
        return f"{known}There may be an excerpt 999 too [chunk:c999]. The rest is not shown [chunk:none]."

    def stream(self, messages: list[dict], size: int = 12) -> Iterator[str]:
        """The same text, so many characters at a time."""
        text = self.generate(messages)
        for at in range(0, len(text), size):
            yield text[at : at + size]


def entity_texts(t: Tables) -> DataFrame:
    """The text of every entity that a reranker is shown, by type; one of a type that isn't here has none."""
    one = lambda df, kind, key, text: df.select(F.lit(kind).alias("entity_type"), F.col(key).cast("long").alias("entity_id"), text.alias("text"))
    titled = rerank_text(F.col("title"), F.col("body"))
    parts = [one(t.chunks, "chunk", "chunk_id", F.col("content")), one(t.commits, "commit", "commit_id", F.col("message"))]
    parts += [one(t.prs, "pr", "pr_id", titled), one(t.issues, "issue", "issue_id", titled)]
    return reduce(DataFrame.unionByName, parts)


#: Names of the settings' retrieval modes.
MODES = ("vector", "bm25", "hybrid", "reranked")


class Retriever(Protocol):
    """Pointers (entity_type, entity_id, score, ...) of the k best for a question."""

    def __call__(self, t: Tables, question: str, k: int, s: Settings, types: set[str] | None = None) -> DataFrame: ...


def retrieve(t: Tables, question: str, k: int, s: Settings, types: set[str] | None = None) -> DataFrame:
    """Pointers by the mode of the settings, in the tables' repository alone; an unknown mode is hybrid, with a warning."""
    mode = {"hybrid_rerank": "reranked"}.get(s.retrieval_mode, s.retrieval_mode)
    if mode not in MODES:
        warnings.warn(f"unknown retrieval mode {s.retrieval_mode!r}: hybrid is used", stacklevel=2)
    if mode == "vector":
        return search.vector_topk(t.embeddings, t.embed(question), k, types)
    if mode == "bm25":
        return search.lexical_topk(t.postings, question, k, types)
    reranked = mode == "reranked" and t.scorer
    near = search.vector_topk(t.embeddings, t.embed(question), s.candidates, types)
    found = search.lexical_topk(t.postings, question, s.candidates, types)
    fused = search.fused_topk({"vector": near, "bm25": found}, max(k, s.input_n) if reranked else k, s.rrf_k)
    return search.reranked_topk(fused, entity_texts(t), t.scorer, k, s.input_n) if reranked else fused


def cited_chunks(t: Tables, pointers: DataFrame) -> DataFrame:
    rows = t.chunks.join(t.files.select("file_id", "path"), "file_id").withColumn("entity_type", F.lit("chunk")).withColumn("entity_id", F.col("chunk_id"))
    return search.hydrate(pointers, rows).withColumn("display_id", F.concat(F.lit("c"), F.col("display").cast("string")))


def search_chunks(t: Tables, question: str, k: int = 5, s: Settings | None = None) -> DataFrame:
    """The k best chunks with their files, in order."""
    return cited_chunks(t, retrieve(t, question, k, s or Settings(), {"chunk"}))


@dataclass
class Answer:
    text: str
    category: str
    confidence: float
    citations: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    trace: dict = field(default_factory=dict)
    sources: list[dict] = field(default_factory=list)


def route(spark: SparkSession, question: str, override: str | None = None, model=None) -> tuple[str, float]:
    """Category and confidence: as told, by a model if one is given, else by keywords."""
    if override:
        return override, 1.0
    got = classify_by_model(spark, question, model) if model else classify_by_keyword(spark, question)
    return got.category, got.confidence


def context_of(t: Tables, question: str, category: str, s: Settings, retriever: Retriever = retrieve) -> tuple[list[DataFrame], dict]:
    """Blocks of the context (kind_rank, nth, block, and what citations resolve to), and a trace.

    Only questions of history expand over the graph: chunks -> commits, pull requests, issues, by cosine to the question.
    """
    trace = {"category": category, "retrieval_mode": s.retrieval_mode, "expansion_candidates": 0}
    if category == "out_of_scope":
        return [], trace
    found = cited_chunks(t, retriever(t, question, s.top_k, s, {"chunk"}))
    kinds = {"chunk": found}
    relations = None
    if category == "historical_why":
        seeds = found.select("entity_type", "entity_id")
        wide = graph.expand(t.edges, seeds, t.repo_id, s.max_depth, s.max_breadth).where("entity_type <> 'chunk'")
        near = graph.rerank_expansion(wide, t.embeddings, t.embed(question), s.top_k)
        for kind, letter, rows, key in (("commit", "m", t.commits, "commit_id"), ("pr", "p", t.prs, "pr_id"), ("issue", "i", t.issues, "issue_id")):
            own = rows.withColumn("entity_type", F.lit(kind)).withColumn("entity_id", F.col(key))
            kinds[kind] = search.hydrate(near.where(F.col("entity_type") == kind), own).withColumn("display_id", F.concat(F.lit(letter), F.col("display").cast("string")))
        context = None
        for df in kinds.values():
            part = df.select("entity_type", "entity_id", "display_id")
            context = part if context is None else context.unionByName(part)
        relations = graph.relations(t.edges, context)
        trace["expansion_candidates"] = wide.count()
    blocks = []
    for nth, (kind, df) in enumerate(kinds.items()):
        df = df.join(relations, ["entity_type", "display_id"], "left") if relations is not None else df.withColumn("phrases", F.lit(None).cast("string"))
        has = lambda c: F.col(c) if c in df.columns else F.lit(None)  # noqa: B023, E731
        blocks.append(df.select(F.lit(nth).alias("kind_rank"), F.col("display").alias("nth"), citations.excerpt(kind).alias("block"), "entity_type",
            "entity_id", "display_id", has("path").cast("string").alias("path"), has("start_line").cast("int").alias("start_line"),
            has("end_line").cast("int").alias("end_line"), has("sha").cast("string").alias("sha"), has("message").cast("string").alias("message"),
            has("number").cast("int").alias("number"), has("title").cast("string").alias("title")))
    return blocks, trace


@functools.lru_cache(16)
def pacer(per_minute: int) -> Pacer:
    """One for all calls with this limit, so that it does limit them."""
    return Pacer(per_minute)


@dataclass
class _Prompt:
    """What a model is asked, and the answer so far."""

    out: Answer
    messages: list[dict]
    shown: DataFrame | None


def _prepare(spark: SparkSession, t: Tables, question: str, s: Settings, override: str | None, retriever: Retriever, model) -> _Prompt:
    began = time.monotonic()
    category, confidence = route(spark, question, override, model if s.classifier == "model" else None)
    routed = time.monotonic()
    blocks, trace = context_of(t, question, category, s, retriever)
    out = Answer("", category, confidence, trace=trace)
    if not blocks:
        return _Prompt(out, [], None)
    rows = reduce(DataFrame.unionByName, blocks)
    shown = rows.orderBy("kind_rank", "nth").collect()  # a top-k
    trace["seeds"] = [r.entity_id for r in shown if r.entity_type == "chunk"]
    trace["seconds"] = {"route": round(routed - began, 4), "retrieve": round(time.monotonic() - routed, 4)}
    out.sources = [{"entity_type": r.entity_type, "display_id": r.display_id} for r in shown]
    messages = citations.build_messages(t.owner, t.name, question, "\n\n".join(r.block for r in shown), category == "historical_why")
    return _Prompt(out, messages, spark.createDataFrame(shown, rows.schema).drop("kind_rank", "nth", "block", "entity_id") if shown else None)


def _finish(spark: SparkSession, t: Tables, prompt: _Prompt, text: str) -> Answer:
    """The answer with its citations checked against what was shown."""
    parsed, out = citations.parse_answer(text), prompt.out
    out.text, out.warnings = text, parsed["warnings"]
    if parsed["citations"] and prompt.shown is not None:
        cited = spark.createDataFrame([(0, c["entity_type"], c["display_id"], c["start"]) for c in parsed["citations"]], "answer_id int, entity_type string, display_id string, start int")
        resolved = citations.resolve_citations(cited, prompt.shown, F.lit(t.owner), F.lit(t.name), ref_of(F.lit(t.sha).cast("string"), F.lit(t.branch)))
        out.citations = [r.asDict() for r in resolved.orderBy("start").collect()]
    return out


def answer(spark: SparkSession, t: Tables, question: str, model=None, s: Settings | None = None, override: str | None = None, retriever: Retriever = retrieve) -> Answer:
    s = s or Settings()
    model = model or MODELS.get(s.model)
    prompt = _prepare(spark, t, question, s, override, retriever, model)
    if not prompt.messages:
        return prompt.out
    pacer(s.requests_per_minute).wait()
    began = time.monotonic()
    text = model.generate(prompt.messages)
    prompt.out.trace["seconds"]["generate"] = round(time.monotonic() - began, 4)
    return _finish(spark, t, prompt, text)


def stream_answer(spark: SparkSession, t: Tables, question: str, model=None, s: Settings | None = None, override: str | None = None, retriever: Retriever = retrieve) -> Iterator[tuple[str, object]]:
    """("sources", …), ("token", …)*, ("citations", …), ("done", …); or ("error", …).

    Tokens are passed on as the model gives them, and the citations are those of what was passed on.
    """
    try:
        s = s or Settings()
        model = model or MODELS.get(s.model)
        prompt = _prepare(spark, t, question, s, override, retriever, model)
        yield "sources", prompt.out.sources
        text = []
        if prompt.messages:
            pacer(s.requests_per_minute).wait()
            for token in model.stream(prompt.messages):
                text.append(token)
                yield "token", token
        out = _finish(spark, t, prompt, "".join(text))
        yield "citations", out.citations
        yield "done", out.trace
    except Exception as e:  # noqa: BLE001  the stream's last event names it
        yield "error", error_text(type(e).__name__, str(e))
