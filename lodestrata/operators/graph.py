"""The typed entity graph: building edges, bounded expansion, relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import closing_refs
from lodestrata.functions.vectors import cosine, vector

EDGE_TYPES = ["introduced_by", "part_of", "references_issue", "closed_by"]
EDGE = ["repo_id", "source_type", "source_id", "target_type", "target_id", "edge_type"]


def edges_of(pairs: DataFrame, edge_type: str, source_type: str, target_type: str, blame_line=None) -> DataFrame:
    """Edge rows from (repo_id, source_id, target_id)."""
    line = F.lit(None).cast("int") if blame_line is None else blame_line
    return pairs.select("repo_id", F.lit(source_type).alias("source_type"), F.col("source_id").cast("long").alias("source_id"),
        F.lit(target_type).alias("target_type"), F.col("target_id").cast("long").alias("target_id"), F.lit(edge_type).alias("edge_type"),
        F.struct(line.alias("blame_line")).alias("edge_metadata"))


def insert_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The edges of `new` that are not there yet, once each."""
    return new.dropDuplicates(EDGE).join(existing.select(*EDGE), EDGE, "left_anti")


def introduced_by(chunks: DataFrame, files: DataFrame, blame: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, shas without a commit row). The commit of a chunk is that of its first line. blame: repo_id, path, line, sha."""
    at = chunks.join(files.select("file_id", "path"), "file_id")
    seen = at.join(blame.withColumnRenamed("line", "start_line"), ["repo_id", "path", "start_line"])
    known = commits.select("repo_id", "sha", F.col("commit_id").alias("target_id"))
    edges = edges_of(seen.join(known, ["repo_id", "sha"]).withColumnRenamed("chunk_id", "source_id"), "introduced_by", "chunk", "commit", F.col("start_line"))
    return edges, seen.join(known, ["repo_id", "sha"], "left_anti").select("repo_id", "sha").distinct()


def part_of(commits: DataFrame, prs: DataFrame) -> DataFrame:
    """commit -> the pull request that merged as it; of several, the one with the largest id."""
    merged = prs.where("merge_commit_sha is not null").groupBy("repo_id", F.col("merge_commit_sha").alias("sha")).agg(F.max("pr_id").alias("target_id"))
    return edges_of(commits.join(merged, ["repo_id", "sha"]).withColumnRenamed("commit_id", "source_id"), "part_of", "commit", "pr")


def pr_issue_links(prs: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references_issue edges, closed_by edges, issues with closing_pr_number).

    References come from closing words in title and body; only a merged pull request closes. Of several, the one with
    the largest id is noted on the issue; an issue without one keeps what it has.
    """
    named = prs.select("repo_id", "pr_id", F.col("number").alias("pr_number"), "merged_at", F.explode(closing_refs(F.col("title"), F.col("body"))).alias("number"))
    linked = named.join(issues.select("repo_id", "number", "issue_id"), ["repo_id", "number"])
    merged = linked.where("merged_at is not null")
    references = edges_of(linked.select("repo_id", F.col("pr_id").alias("source_id"), F.col("issue_id").alias("target_id")), "references_issue", "pr", "issue")
    closed = edges_of(merged.select("repo_id", F.col("issue_id").alias("source_id"), F.col("pr_id").alias("target_id")), "closed_by", "issue", "pr")
    closing = merged.groupBy("repo_id", "issue_id").agg(F.max_by("pr_number", "pr_id").alias("__closing"))
    noted = issues.join(closing, ["repo_id", "issue_id"], "left").withColumn("closing_pr_number", F.coalesce("__closing", "closing_pr_number")).drop("__closing")
    return references, closed, noted


def expand(edges: DataFrame, seeds: DataFrame, repo_id: int, max_depth: int = 2, max_breadth: int = 10) -> DataFrame:
    """(entity_type, entity_id, depth) reached from the seeds (entity_type, entity_id) along edges; seeds are left out.

    One join for each level over distinct frontiers, so that a cycle adds rows of a seed once a level, not once a path. For each
    seed the max_breadth nearest, by depth and id, count.
    """
    own = edges.where(F.col("repo_id") == repo_id).select(F.col("source_type").alias("entity_type"), F.col("source_id").alias("entity_id"), "target_type", "target_id")
    front = seeds.select(F.col("entity_id").alias("origin"), "entity_type", "entity_id")
    levels = []
    for depth in range(1, max_depth + 1):
        front = front.join(own, ["entity_type", "entity_id"]).select("origin", F.col("target_type").alias("entity_type"), F.col("target_id").alias("entity_id")).distinct()
        levels.append(front.withColumn("depth", F.lit(depth)))
    reached = reduce(DataFrame.unionByName, levels).groupBy("origin", "entity_type", "entity_id").agg(F.min("depth").alias("depth"))
    number = F.row_number().over(Window.partitionBy("origin").orderBy("depth", "entity_id", "entity_type"))
    near = reached.withColumn("n", number).where(F.col("n") <= max_breadth)
    return near.groupBy("entity_type", "entity_id").agg(F.min("depth").alias("depth"))


def expand_sql(edges_view: str, seeds_view: str, repo_id: int, max_depth: int = 2, max_breadth: int = 10) -> str:
    """The same as a query: a table for each level, of distinct rows. A recursive one holds every path, and Spark bounds its rows."""
    level = lambda d: f"""l{d} AS (SELECT DISTINCT w.origin, e.target_type AS entity_type, e.target_id AS entity_id FROM l{d - 1} w JOIN {edges_view} e
          ON e.repo_id = {repo_id} AND e.source_type = w.entity_type AND e.source_id = w.entity_id)"""  # noqa: E731
    depths = range(1, max_depth + 1)
    return f"""WITH l0 AS (SELECT entity_id AS origin, entity_type, entity_id FROM {seeds_view}),
      {", ".join(map(level, depths))},
      walk AS ({" UNION ALL ".join(f"SELECT *, {d} AS depth FROM l{d}" for d in depths)}),
      near AS (SELECT origin, entity_type, entity_id, min(depth) AS depth FROM walk GROUP BY origin, entity_type, entity_id),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY depth, entity_id, entity_type) AS n FROM near)
      SELECT entity_type, entity_id, min(depth) AS depth FROM numbered WHERE n <= {max_breadth} GROUP BY entity_type, entity_id"""


def rerank_expansion(candidates: DataFrame, embeddings: DataFrame, query, k: int) -> DataFrame:
    """Candidates by cosine to the query; those without an embedding go."""
    keys = ["entity_type", "entity_id"]
    rows = embeddings.join(candidates.select(*keys), keys, "left_semi")
    return rows.select(*keys, cosine(F.col("embedding"), vector(query)).alias("score")).orderBy(F.desc("score"), *keys).limit(k)


def relations(edges: DataFrame, context: DataFrame) -> DataFrame:
    """(entity_type, display_id, phrases): what the context's rows (entity_type, entity_id, display_id) say of each other."""
    end = lambda side: context.select(F.col("entity_type").alias(f"{side}_type"), F.col("entity_id").alias(f"{side}_id"), F.col("display_id").alias(f"{side}_d"))
    both = edges.join(end("source"), ["source_type", "source_id"]).join(end("target"), ["target_type", "target_id"])
    token = lambda side: F.concat(F.lit("["), F.col(f"{side}_type"), F.lit(":"), F.col(f"{side}_d"), F.lit("]"))
    kind, source, target = F.col("edge_type"), token("source"), token("target")
    told = both.select(
        F.when(kind == "introduced_by", F.struct(F.col("target_type").alias("t"), F.col("target_d").alias("d"), F.concat(F.lit("introduced "), source).alias("p")))
        .when(kind == "part_of", F.struct(F.col("target_type").alias("t"), F.col("target_d").alias("d"), F.concat(F.lit("contains "), source).alias("p")))
        .when(kind == "references_issue", F.struct(F.col("source_type").alias("t"), F.col("source_d").alias("d"), F.concat(F.lit("references "), target).alias("p")))
        .otherwise(F.struct(F.col("source_type").alias("t"), F.col("source_d").alias("d"), F.concat(F.lit("closed by "), target).alias("p"))).alias("r"))
    return told.groupBy(F.col("r.t").alias("entity_type"), F.col("r.d").alias("display_id")).agg(F.array_join(F.array_sort(F.collect_set("r.p")), ", ").alias("phrases"))
