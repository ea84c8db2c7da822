"""Repository trees and git metadata as DataFrames."""

from __future__ import annotations

import re
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import MAX_FILE_BYTES, MAX_FILES, language, skipped


def scan_tree(spark: SparkSession, root: str, repo_id: int, with_text: bool = True) -> DataFrame:
    """repo_id, file_id, path, size_bytes, language, text of the files that a scan keeps.

    Names and sizes decide before any content is read; rows are in order of path. Bad bytes are replaced. Over the limit of
    files nothing is read.
    """
    base = root.rstrip("/").removeprefix("file:")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MAX_FILE_BYTES)
    # files are told by name and size first: content is not among the columns of that scan, so none is read
    rel = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/*", "/"), f"^{re.escape(base)}/", "")
    listed = raw.select("path", F.col("length").alias("size_bytes"), rel(F.col("path")).alias("rel"))
    kept = listed.where(~skipped(F.col("rel"), F.col("size_bytes")))
    columns = [F.lit(repo_id).cast("long").alias("repo_id"), F.xxhash64(F.lit(repo_id), "rel").alias("file_id"), F.col("rel").alias("path"), "size_bytes", language(F.col("rel")).alias("language")]
    if not with_text:
        return kept.select(*columns).orderBy("path")

    @F.arrow_udf("string")
    def decoded(content: pa.Array) -> pa.Array:
        return pa.array([None if c is None else c.as_buffer().to_pybytes().decode("utf-8", errors="replace") for c in content], pa.string())

    # of several thousand files at most, the limit of a scan: their paths, and then their content alone
    paths = [r.path for r in kept.select("path").limit(MAX_FILES + 1).collect()]
    if not paths:
        return kept.select(*columns, F.lit("").alias("text")).limit(0)
    if len(paths) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files")
    escaped = [re.sub(r"([\\*?\[\]{}])", r"\\\1", x) for x in paths]
    content = spark.read.format("binaryFile").load(escaped)
    content = content.select(F.col("length").alias("size_bytes"), rel(F.col("path")).alias("rel"), decoded("content").alias("text"))
    return content.select(*columns, "text").orderBy("path")


def check_file_count(files: DataFrame, most: int = MAX_FILES) -> int:
    n = files.count()
    if n > most:
        raise ValueError(f"{n} files, over the limit of {most}")
    return n


def clone(url: str, to: str) -> tuple[str, str]:
    """(branch, sha) of a shallow clone; url may be a local path."""
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", url, to], check=True, capture_output=True)
    git = lambda *a: subprocess.run(["git", "-C", to, *a], check=True, capture_output=True, text=True).stdout.strip()
    return git("rev-parse", "--abbrev-ref", "HEAD"), git("rev-parse", "HEAD")


def parse_blame(porcelain: DataFrame) -> DataFrame:
    """repo_id, path, line, sha from rows (repo_id, path, porcelain); of a line named twice the later sha counts."""
    line = porcelain.select("repo_id", "path", F.posexplode(F.split("porcelain", "\n")).alias("at", "line"))
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    rows = line.where(F.col("line").rlike(head)).select("repo_id", "path", "at", F.regexp_extract("line", head, 1).alias("sha"), F.regexp_extract("line", head, 2).cast("int").alias("line"))
    return rows.groupBy("repo_id", "path", "line").agg(F.max_by("sha", "at").alias("sha"))


def blame(files: DataFrame, root: str) -> DataFrame:
    """parse_blame of files (repo_id, path): git runs once for each file, where a worker can see the tree."""

    def run(batches):
        for b in batches:
            out = []
            for p in b["path"]:
                got = subprocess.run(["git", "-C", root, "blame", "--porcelain", "--", p], capture_output=True, text=True, errors="replace")
                out.append(got.stdout if got.returncode == 0 else None)
            yield b.assign(porcelain=out)

    raw = files.select("repo_id", "path").mapInPandas(run, "repo_id long, path string, porcelain string")
    return parse_blame(raw.where("porcelain is not null"))


def commit_stubs(shas: DataFrame, root: str) -> DataFrame:
    """Commit rows of (repo_id, sha) from git itself, where a worker can see the tree; unknown shas have none."""

    def run(batches):
        for b in batches:
            out = []
            for sha in b["sha"]:
                got = subprocess.run(["git", "-C", root, "log", "-1", "--format=%H%x00%an%x00%ae%x00%aI%x00%cI%x00%B", sha], capture_output=True, text=True, errors="replace")
                out.append(got.stdout if got.returncode == 0 else None)
            yield b.assign(raw=out)

    raw = shas.select("repo_id", "sha").mapInPandas(run, "repo_id long, sha string, raw string").where("raw is not null")
    return raw.select("repo_id", parse_commit_stub(F.col("raw")).alias("s")).where("s is not null").select("repo_id", "s.*")


def parse_commit_stub(raw):
    """struct(sha, author_name, author_email, authored_at, committed_at, message) from NUL-separated fields; empty ones are null."""
    p = F.split(raw, "\\x00", 6)
    some = lambda i: F.nullif(p[i], F.lit(""))
    times = [some(i).try_cast("timestamp").alias(n) for i, n in ((3, "authored_at"), (4, "committed_at"))]
    fields = [p[0].alias("sha"), some(1).alias("author_name"), some(2).alias("author_email"), *times, F.regexp_replace(p[5], r"\n+$", "").alias("message")]
    return F.when(F.size(p) == 6, F.struct(*fields))
