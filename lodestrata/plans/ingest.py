"""The write path: a repository's files, chunks, embeddings and graph as tables partitioned by repository."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.vectors import hash_embed
from lodestrata.operators import graph
from lodestrata.operators.chunking import chunk_files
from lodestrata.plans import jobs
from lodestrata.plans.store import Store
from lodestrata.plans.upsert import insert_if_absent, replace_partitions
from lodestrata.sources import tree
from lodestrata.tables import file_system, remove, shared_dir


def parse_url(url: str) -> tuple[str, str]:
    import re

    m = re.fullmatch(T.REPO_URL.strip("^$"), url.strip())
    if not m:
        raise ValueError(f"not a public repository's address: {url!r}")
    return m.group(1), m.group(2)


#: What is made from a repository's files and history, by table.
DERIVED = ("embedding", "posting", "edge")
HISTORY = ("commit", "pull_request", "issue", "comment")


def staged(df: DataFrame, path: str) -> str | None:
    """A repository's rows of a table, written beside it; None: there are none."""
    part = f"{path}--{uuid.uuid4().hex}"
    df.drop("repo_id").write.parquet(part)
    if df.sparkSession.read.schema(df.drop("repo_id").schema).parquet(part).take(1):
        return part
    remove(df.sparkSession, part)
    return None


def put_repo(spark: SparkSession, part: str | None, path: str, repo_id: int) -> None:
    """Staged rows in place of those that the repository had, also where there are none any more: a removal and a rename."""
    target = f"{path}/repo_id={repo_id}"
    remove(spark, target)
    if part:
        fs, p = file_system(spark, target)
        fs.mkdirs(p.getParent())
        fs.rename(file_system(spark, part)[1], p)


def drop_repo(spark: SparkSession, store: str, repo_id: int) -> None:
    """Take out all that was made from a repository: embeddings, postings, edges and history of every kind, and where its stages stood."""
    history = Store(spark, f"{store}/history")
    if history.version() >= 0:
        history.forget(f"{repo_id}/")
        for table in HISTORY:
            history.delete(table, repo_id)
    remove(spark, f"{store}/checkpoint/{repo_id}")
    for table in DERIVED:
        remove(spark, f"{store}/{table}/repo_id={repo_id}")


def ingest_repo(spark: SparkSession, url: str, store: str, repo_id: int, local: str | None = None) -> dict:
    """Files and chunks of a repository, in place of what the store had of it. local: a tree to read instead of cloning, on
    storage that executors share; a clone goes beside the tables.

    Nothing is written when the address is malformed or the tree holds too many files. Files and chunks are made beside the
    tables first; only when they are whole does what the store had of the repository go (drop_repo), and they are renamed
    into its place. The history is at `history` in the store, its streams' checkpoint at `checkpoint/<repo_id>`. A file that
    can't be chunked has no chunks; if chunking fails as a whole, the files stay and `chunk_error` says why.
    """
    owner, name = parse_url(url)
    branch = sha = None
    if local is None:
        local = f"{shared_dir(spark)}/lodestrata-clone-{uuid.uuid4().hex}"
        branch, sha = tree.clone(url, local)
    files = tree.scan_tree(spark, local, repo_id)
    n = tree.check_file_count(files)
    error = chunks = None
    held = staged(files.drop("text"), f"{store}/file")
    try:
        chunks = staged(chunk_files(files), f"{store}/chunk")
    except Exception as e:  # noqa: BLE001  files are of use without chunks
        error = T.error_text(type(e).__name__, str(e))
    drop_repo(spark, store, repo_id)
    put_repo(spark, chunks, f"{store}/chunk", repo_id)
    put_repo(spark, held, f"{store}/file", repo_id)
    row = [(owner, name, branch, sha, datetime.now(UTC), repo_id)]
    schema = "owner string, name string, default_branch string, commit_sha string, ingested_at timestamp, repo_id bigint"
    replace_partitions(spark.createDataFrame(row, schema), f"{store}/repo", ["repo_id"])
    return {"owner": owner, "name": name, "branch": branch, "sha": sha, "files": n, "root": local, "chunk_error": error}


def texts_to_embed(chunks: DataFrame | None, commits: DataFrame | None, prs: DataFrame | None, issues: DataFrame | None) -> dict[str, DataFrame]:
    """(entity_id, text) by type; what has nothing to embed is left out, by each type's own rule."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    out = {}
    if chunks is not None:
        out["chunk"] = chunks.where(has("content")).select("repo_id", F.col("chunk_id").alias("entity_id"), F.col("content").alias("text"))
    if commits is not None:
        out["commit"] = commits.where(F.col("message").rlike(r"(?U)\S")).select("repo_id", F.col("commit_id").alias("entity_id"), F.col("message").alias("text"))
    for kind, rows in (("pr", prs), ("issue", issues)):
        if rows is not None:
            out[kind] = rows.where(has("title") | has("body")).select("repo_id", F.col(f"{kind}_id").alias("entity_id"), T.join_title_body(F.col("title"), F.col("body")).alias("text"))
    return out


#: Models that a worker has loaded, by name.
_LOADED: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """What load() gives, once a worker process, however many tasks and batches ask for it by that name."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def batched(embed: Callable[[list[str]], list[list[float]]] | None = None, size: int = 32, load: Callable[[], Callable] | None = None, name: str = "") -> Callable[[Column], Column]:
    """A model's function of a list of texts as a column of vectors, `size` texts at a time; a batch that fails gives nulls.

    embed: the function; or load, which gives it, and the model's name: then each worker loads it once. A load that fails fails the task.
    """

    @F.arrow_udf("array<float>")
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = embed or loaded(name or f"{load.__module__}.{load.__qualname__}", load)
        for texts in parts:
            out = []
            for at in range(0, len(texts), size):
                part = texts.slice(at, size).to_pylist()
                try:
                    out += model(part)
                except Exception:  # noqa: BLE001  others are embedded even so
                    out += [None] * len(part)
            yield pa.array(out, pa.list_(pa.float32()))

    return lambda c: vectors(c)


def embed_repo(texts: dict[str, DataFrame], store: str, dim: int = 384, embed: Callable[[Column], Column] | None = None, model: str = "hashing") -> dict[str, dict]:
    """One polymorphic table, partitioned by repository and type, written a type at a time: a type without rows, or one
    that fails, keeps what it had. Rows whose vector is null are skipped. Returns {type: {embedded, skipped, error}}.
    """
    vector, out = embed or (lambda c: hash_embed(c, dim)), {}
    for kind, t in texts.items():
        rows = t.select("repo_id", F.lit(kind).alias("entity_type"), "entity_id", vector(F.col("text")).cast("array<float>").alias("embedding"), F.lit(model).alias("model_name"), F.lit(dim).alias("dimension"))
        seen = Observation()
        try:
            counted = rows.observe(seen, F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("skipped"))
            replace_partitions(counted.where("embedding is not null"), f"{store}/embedding", ["repo_id", "entity_type"])
            out[kind] = {**seen.get, "error": None}
        except Exception as e:  # noqa: BLE001  the status carries it
            out[kind] = {"embedded": 0, "skipped": None, "error": T.error_text(type(e).__name__, str(e))}
    return out


def embed_job(spark: SparkSession, texts: dict[str, DataFrame], store: str, repo_id: int, **how) -> dict:
    """embed_repo as a job with a status: failed where a type fails, or where rows were to be embedded and none was."""

    def work(report: Callable[[float], None]) -> None:
        told = {}
        for k, (kind, rows) in enumerate(texts.items()):
            told |= embed_repo({kind: rows}, store, **how)
            report((k + 1) / len(texts))
        errors = [f"{k}: {r['error']}" for k, r in told.items() if r["error"]]
        if errors:
            raise RuntimeError("; ".join(errors))
        if not any(r["embedded"] for r in told.values()) and any(r["skipped"] for r in told.values()):
            raise RuntimeError(f"none of {sum(r['skipped'] for r in told.values())} rows could be embedded")

    return jobs.run(spark, store, repo_id, "embedding", work)


def write_postings(rows: DataFrame, path: str, files: int) -> None:
    """Postings by repository and type, in order of lexeme: a search reads the few pages that hold its lexemes.

    Ranges go by lexeme and entity, so that a frequent lexeme fills several files.
    """
    order = ["entity_type", "lexeme", "entity_id", "pos"]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.partitionBy("repo_id", "entity_type").parquet(path)


def build_graph(chunks: DataFrame, files: DataFrame, blame: DataFrame, commits: DataFrame, prs: DataFrame, issues: DataFrame, stubs: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """edges, commits (with stubs of those that blame names and history lacks) and issues (with what closed them).

    stubs: shas without a row -> commit rows; they get ids from their natural key and never replace a row.
    """
    _, unknown = graph.introduced_by(chunks, files, blame, commits)
    if stubs is not None:
        commits = insert_if_absent(commits, stubs(unknown).withColumn("commit_id", F.xxhash64("repo_id", "sha")), ["repo_id", "sha"])
    by_blame, _ = graph.introduced_by(chunks, files, blame, commits)
    references, closed, noted = graph.pr_issue_links(prs, issues)
    edges = reduce(DataFrame.unionByName, [by_blame, graph.part_of(commits, prs), references, closed]).dropDuplicates(graph.EDGE)
    return {"edges": edges, "commits": commits, "issues": noted}
