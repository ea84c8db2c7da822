"""The tables of a repository, as DDL. Tables are Parquet, partitioned by repo_id; a new version of a schema is a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

META = "struct<decorators:array<string>,is_classmethod:boolean,is_staticmethod:boolean,is_property:boolean>"
JOB = "struct<status:string,progress:double,started_at:timestamp,completed_at:timestamp,error:string>"
STAGE = "struct<cursor:string,count:bigint,done:boolean>"
TABLES = {
    "repo": f"repo_id bigint, owner string, name string, default_branch string, commit_sha string, ingested_at timestamp, embedding {JOB}, history {JOB}, graph {JOB}, history_state struct<window_since:timestamp,commits:{STAGE},pull_requests:{STAGE},issues:{STAGE}>",
    "file": "repo_id bigint, file_id bigint, path string, size_bytes bigint, language string",
    "chunk": f"repo_id bigint, chunk_id bigint, file_id bigint, chunk_type string, name string, parent_name string, start_line int, end_line int, content string, language string, is_async boolean, extra_metadata {META}",
    "embedding": "repo_id bigint, entity_type string, entity_id bigint, embedding array<float>, model_name string, dimension int",
    "commit": "repo_id bigint, commit_id bigint, sha string, author_name string, author_email string, authored_at timestamp, committed_at timestamp, message string, parent_shas array<string>, files_changed_count int, additions int, deletions int",
    "pull_request": "repo_id bigint, pr_id bigint, number int, title string, body string, state string, author string, created_at timestamp, merged_at timestamp, closed_at timestamp, merge_commit_sha string, base_branch string, head_branch string, files_changed_count int, additions int, deletions int",
    "comment": "repo_id bigint, number int, github_id bigint, author string, body string, created_at timestamp, comment_type string",
    "issue": "repo_id bigint, issue_id bigint, number int, title string, body string, state string, author string, created_at timestamp, closed_at timestamp, labels array<string>, closing_pr_number int",
    "edge": "repo_id bigint, source_type string, source_id bigint, target_type string, target_id bigint, edge_type string, edge_metadata struct<blame_line:int>",
    "posting": "repo_id bigint, entity_type string, entity_id bigint, lexeme string, pos int, weight string",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str, *more: str) -> DataFrame:
    """df with a table's columns, in order and type, and `more` of its own; a column that it lacks is null. Nothing is cut to a length."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)], *more)
