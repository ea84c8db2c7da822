"""Citations: finding them in an answer, checking them against a context, and what a model is shown."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import commit_title, permalink, strip_ws

# Fixed value: the form of a citation.
TOKEN = re.compile(r"\[(chunk|commit|pr|issue):(none|[A-Za-z0-9_-]{1,16})\]")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_TICKS = re.compile(r"`+")
PARSED = "struct<citations:array<struct<entity_type:string,display_id:string,start:int,end:int>>,warnings:array<string>>"


def _without_spans(line: str) -> str:
    """The line with code spans blanked: from a run of backticks to the next run as long, if there is one."""
    runs = [(m.start(), m.end()) for m in _TICKS.finditer(line)]
    out, i = list(line), 0
    while i < len(runs):
        a, b = runs[i]
        close = next((k for k in range(i + 1, len(runs)) if runs[k][1] - runs[k][0] == b - a), None)
        if close is None:
            i += 1
            continue
        out[a : runs[close][1]] = " " * (runs[close][1] - a)
        i = close + 1
    return "".join(out)


def parse_answer(answer: str | None) -> dict:
    """Citations outside fenced blocks and code spans, with offsets, and warnings."""
    found, at, fence = [], 0, ""
    for line in (answer or "").splitlines(keepends=True):
        mark = _FENCE.match(line)
        if mark:
            run = mark.group(1)
            if not fence:
                fence = run
            elif run[0] == fence[0] and len(run) >= len(fence):
                fence = ""
        elif not fence:
            found += [{"entity_type": m.group(1), "display_id": m.group(2), "start": at + m.start(), "end": at + m.end()} for m in TOKEN.finditer(_without_spans(line))]
        at += len(line)
    return {"citations": found, "warnings": ["fence_unterminated"] if fence else []}


def parse_citations(answers: DataFrame, column: str = "answer") -> DataFrame:
    """answers + parsed. A state machine over lines: Arrow batches, no row moves."""
    return answers.withColumn("parsed", F.udf(parse_answer, PARSED, useArrow=True)(F.col(column)))


def resolve_citations(cited: DataFrame, context: DataFrame, owner: Column, name: Column, ref: Column) -> DataFrame:
    """Each distinct citation (answer_id, entity_type, display_id, start), first seen first, with status and link.

    context: entity_type, display_id, path, start_line, end_line, sha, message, number, title. valid: in the context; none: the sentinel; invalid: else.
    """
    first = Window.partitionBy("answer_id", "entity_type", "display_id").orderBy("start")
    once = cited.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    joined = once.join(context.withColumn("known", F.lit(True)), ["entity_type", "display_id"], "left")
    valid = (F.col("display_id") != "none") & F.col("known").isNotNull()
    kind = F.col("entity_type")
    link = (
        F.when(kind == "chunk", permalink("chunk", owner, name, ref, F.col("path"), F.col("start_line"), F.col("end_line")))
        .when(kind == "commit", permalink("commit", owner, name, F.col("sha")))
        .when(kind == "pr", permalink("pr", owner, name, F.col("number")))
        .otherwise(permalink("issue", owner, name, F.col("number")))
    )
    title = F.when(kind == "commit", commit_title(F.col("message"))).when(kind != "chunk", F.col("title"))
    status = F.when(F.col("display_id") == "none", "none").when(valid, "valid").otherwise("invalid")
    return joined.select("answer_id", "entity_type", "display_id", "start", status.alias("status"), F.when(valid, title).alias("title"), F.when(valid, link).alias("permalink"))


def _cut(body: Column, n: int = 500) -> Column:
    b = strip_ws(F.coalesce(body, F.lit("")))
    return F.concat(F.substring(b, 1, n), F.when(F.length(b) > n, "...").otherwise(""))


def excerpt(kind: str) -> Column:
    """The block that shows one entity of a context, from its columns and `phrases` (may be null)."""
    rel = F.when(F.coalesce("phrases", F.lit("")) != "", F.concat(F.lit("  ("), F.col("phrases"), F.lit(")"))).otherwise("")
    head = lambda *parts: F.concat(F.lit("["), F.col("display_id"), F.lit("] "), *parts, rel)
    day = lambda c, other: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(other))
    s = lambda c: F.col(c).cast("string")
    if kind == "chunk":
        what = F.concat(F.col("chunk_type"), F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit(" "), F.col("name"))).otherwise(""))
        h = head(F.lit("code: "), F.col("path"), F.lit(":"), s("start_line"), F.lit("-"), s("end_line"), F.lit(" ("), what, F.lit(")"))
        return F.concat(h, F.lit("\n```"), F.lower(F.coalesce("language", F.lit(""))), F.lit("\n"), F.col("content"), F.lit("\n```"))
    if kind == "commit":
        h = head(F.lit("commit: "), F.substring("sha", 1, 7), F.lit(" by "), F.coalesce(F.nullif("author_name", F.lit("")), F.lit("unknown")), F.lit(" on "), day(F.col("authored_at"), "unknown"))
        return F.concat(h, F.lit("\nMessage: "), strip_ws(F.coalesce("message", F.lit(""))))
    when = day(F.col("merged_at" if kind == "pr" else "closed_at"), "open")
    h = head(F.lit(f"{kind}: #"), s("number"), F.lit(' "'), F.col("title"), F.lit('" ('), F.col("state"), F.lit(", "), when, F.lit(")"))
    return F.concat(h, F.when(_cut(F.col("body")) != "", F.concat(F.lit("\nBody: "), _cut(F.col("body")))).otherwise(""))


def render(excerpts: DataFrame) -> str:
    """All blocks (kind_rank, nth, block) of a context, in order. A context is a top-k: it fits the driver."""
    return "\n\n".join(r.block for r in excerpts.orderBy("kind_rank", "nth").select("block").collect())


SYSTEM = {
    "flat": "Answer questions on the repository {owner}/{name} from the numbered excerpts alone. After each claim name its excerpt as [chunk:c1]; a claim no excerpt supports ends in [chunk:none]. Use no id that is not shown, put no citation in code, and say so if the excerpts don't suffice.",
    "why": "Explain why the code of the repository {owner}/{name} is as it is, from the excerpts alone: code, commits, pull requests and issues. After each claim name its excerpt as [chunk:c1], [commit:m1], [pr:p1] or [issue:i1], and follow chains from issue to code; a claim no excerpt supports ends in [chunk:none]. Use no id that is not shown, put no citation in code, and say so if the excerpts don't suffice.",
}
USER = "Question: {question}\n\nExcerpts:\n{excerpts}"


def build_messages(owner: str, name: str, question: str, excerpts: str, why: bool = False) -> list[dict]:
    return [{"role": "system", "content": SYSTEM["why" if why else "flat"].format(owner=owner, name=name)}, {"role": "user", "content": USER.format(question=question, excerpts=excerpts)}]
