"""Paged history (commits, pull requests, issues): pages as JSON, flattened to rows."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, SimpleDataSourceStreamReader

COMMENT = "struct<databaseId:bigint,body:string,author:struct<login:string>,createdAt:string>"
NODES = {
    "commits": "struct<oid:string,message:string,authoredDate:string,committedDate:string,updatedAt:string,author:struct<name:string,email:string>,additions:int,deletions:int,changedFilesIfAvailable:int,parents:struct<nodes:array<struct<oid:string>>>>",
    "pull_requests": f"struct<number:int,title:string,body:string,state:string,author:struct<login:string>,createdAt:string,updatedAt:string,mergedAt:string,closedAt:string,mergeCommit:struct<oid:string>,baseRefName:string,headRefName:string,additions:int,deletions:int,changedFiles:int,comments:struct<nodes:array<{COMMENT}>>,reviews:struct<nodes:array<{COMMENT}>>>",
    "issues": f"struct<number:int,title:string,body:string,state:string,author:struct<login:string>,createdAt:string,updatedAt:string,closedAt:string,labels:struct<nodes:array<struct<name:string>>>,comments:struct<nodes:array<{COMMENT}>>>",
}
# Where a page's connection stands in its answer.
PATHS = {"commits": "$.repository.defaultBranchRef.target.history", "pull_requests": "$.repository.pullRequests", "issues": "$.repository.issues"}


def nodes_of(pages: DataFrame, stage: str, column: str = "page") -> DataFrame:
    """pages' other columns and `node`, one row a node; a page without the connection has none."""
    connection = F.from_json(F.get_json_object(column, PATHS[stage]), f"struct<nodes:array<{NODES[stage]}>,pageInfo:struct<hasNextPage:boolean,endCursor:string>>")
    return pages.withColumn("node", F.explode(connection["nodes"])).drop(column)


def within(nodes: DataFrame, since) -> DataFrame:
    """Nodes updated at `since` or later; those without a time are left out. A fixed cut-off, not a watermark."""
    return nodes.where(F.col("node.updatedAt").try_cast("timestamp") >= since)


def commits(nodes: DataFrame, *more: str) -> DataFrame:
    n = lambda x: F.col(f"node.{x}")
    return nodes.select("repo_id", n("oid").alias("sha"), n("author.name").alias("author_name"), n("author.email").alias("author_email"),
        n("authoredDate").cast("timestamp").alias("authored_at"), n("committedDate").cast("timestamp").alias("committed_at"),
        F.coalesce(n("message"), F.lit("")).alias("message"), F.coalesce(n("parents.nodes.oid"), F.array().cast("array<string>")).alias("parent_shas"),
        n("changedFilesIfAvailable").alias("files_changed_count"), n("additions").alias("additions"), n("deletions").alias("deletions"), *more)


def pull_requests(nodes: DataFrame, *more: str) -> DataFrame:
    n = lambda x: F.col(f"node.{x}")
    t = lambda x: n(x).cast("timestamp")
    return nodes.select("repo_id", n("number").alias("number"), F.coalesce(n("title"), F.lit("")).alias("title"), n("body").alias("body"),
        F.lower(F.coalesce(n("state"), F.lit(""))).alias("state"), n("author.login").alias("author"), t("createdAt").alias("created_at"),
        t("mergedAt").alias("merged_at"), t("closedAt").alias("closed_at"), n("mergeCommit.oid").alias("merge_commit_sha"),
        n("baseRefName").alias("base_branch"), n("headRefName").alias("head_branch"), n("changedFiles").alias("files_changed_count"),
        n("additions").alias("additions"), n("deletions").alias("deletions"), *more)


def issues(nodes: DataFrame, *more: str) -> DataFrame:
    n = lambda x: F.col(f"node.{x}")
    t = lambda x: n(x).cast("timestamp")
    return nodes.select("repo_id", n("number").alias("number"), F.coalesce(n("title"), F.lit("")).alias("title"), n("body").alias("body"),
        F.lower(F.coalesce(n("state"), F.lit(""))).alias("state"), n("author.login").alias("author"), t("createdAt").alias("created_at"),
        t("closedAt").alias("closed_at"), F.coalesce(n("labels.nodes.name"), F.array().cast("array<string>")).alias("labels"), *more)


def comments(nodes: DataFrame, reviews: bool = False) -> DataFrame:
    """repo_id, number, github_id, author, body, created_at, comment_type; reviews without a body are left out."""
    kind = "review_body" if reviews else "issue_comment"
    each = nodes.select("repo_id", "node.number", F.explode(f"node.{'reviews' if reviews else 'comments'}.nodes").alias("c"))
    rows = each.select("repo_id", "number", F.col("c.databaseId").alias("github_id"), F.col("c.author.login").alias("author"),
        F.coalesce("c.body", F.lit("")).alias("body"), F.col("c.createdAt").cast("timestamp").alias("created_at"), F.lit(kind).alias("comment_type"))
    return rows.where(F.col("body").rlike(r"(?U)\S")) if reviews else rows


class AuthError(RuntimeError):
    """The service refused the token."""


class QueryError(RuntimeError):
    """The service gave no data."""


#: What becomes of an answer: the first line whose test of (status, body) holds.
OUTCOMES = (
    ("refused", lambda status, body: status == 401),
    ("limited", lambda status, body: status == 403 and "rate limit" in body.lower()),
    ("refused", lambda status, body: status == 403),
    ("broken", lambda status, body: status >= 500),
    ("failed", lambda status, body: status >= 400),
    ("answered", lambda status, body: True),
)


class PagedClient:
    """One query at a time: 4 attempts, waits of 1, 2, 4 s after network errors and 5xx, pauses where a rate limit says so.

    send(query, variables, token) -> (status, headers, body) is the transport; tests give a canned one.
    """

    def __init__(self, send: Callable, token: str, attempts: int = 4, floor: int = 50, longest: float = 3600.0, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time) -> None:
        self.send, self.token, self.attempts, self.floor, self.longest, self.sleep, self.now = send, token, attempts, floor, longest, sleep, now

    def ask(self, query: str, variables: dict) -> tuple[str, object]:
        """(outcome, what is known of it): one attempt."""
        try:
            status, headers, body = self.send(query, variables, self.token)
        except OSError as e:
            return "broken", e
        outcome = next(name for name, holds in OUTCOMES if holds(status, body))
        if outcome == "limited":
            return outcome, self.until_reset(headers)
        return outcome, body if outcome == "answered" else f"status {status}: {body[:200]}"

    def execute(self, query: str, variables: dict) -> dict:
        """The answer's data, {} where it is null; AuthError, QueryError or the network's own error where there is none."""
        pause, known = 1.0, None
        for attempt in range(1, self.attempts + 1):
            outcome, known = self.ask(query, variables)
            if outcome == "answered":
                return self.data_of(json.loads(known))
            if outcome == "refused":
                raise AuthError(known)
            if outcome == "failed":
                raise QueryError(known)
            if attempt < self.attempts:
                self.sleep(known if outcome == "limited" else pause)
                pause *= 1 if outcome == "limited" else 2
        if isinstance(known, OSError):
            raise known
        raise QueryError(f"no answer in {self.attempts} attempts: {known}")

    def until_reset(self, headers: dict) -> float:
        """Seconds until the header's time, 1 at least; 60 without one that can be read."""
        at = {k.lower(): v for k, v in headers.items()}.get("x-ratelimit-reset")
        try:
            left = max(float(at) - self.now(), 1.0)
        except (TypeError, ValueError):
            left = 60.0
        return min(left, self.longest)

    def data_of(self, answer: dict) -> dict:
        """The data; after a pause if little of the limit is left."""
        if answer.get("errors"):
            raise QueryError(f"query failed: {[e.get('message', '') for e in answer['errors'][:2]]}")
        data = answer.get("data") or {}
        limit = data.get("rateLimit") or {}
        if limit.get("remaining") is not None and limit["remaining"] <= self.floor and (at := instant(limit.get("resetAt"))) is not None:
            left = at.timestamp() - self.now()
            if left > 0:
                self.sleep(min(left, self.longest))
        return data


def instant(text: object) -> datetime | None:
    """An ISO time, in UTC where it names no zone; None for anything else."""
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except (AttributeError, ValueError):
        return None
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def connection_of(data: dict, stage: str) -> dict | None:
    """A page's connection; None where any step of the way to it is missing."""
    for step in PATHS[stage].removeprefix("$.").split("."):
        data = (data or {}).get(step)
    return data


def is_late(node: dict, since: datetime) -> bool:
    """Updated before `since`, or at no time that can be read."""
    at = instant(node.get("updatedAt"))
    return at is None or at < since


def fetch_pages(client: PagedClient, query: str, variables: dict, stage: str, to: str, since: str | None = None) -> int:
    """Write the pages of a connection to a folder, one file each, from the last one that is there; returns how many there are.

    Paging ends with the last page, without a connection, or, for what comes newest first, at a page whose nodes are all
    older than `since` (an ISO time): all later ones are older still. A page is stored before the next is asked for.
    """
    fs, base = _store(to)
    fs.create_dir(base, recursive=True)
    n, cursor = 0, None
    cut = instant(since) if stage != "commits" else None
    while (held := _read(fs, f"{base}/{stage}-{n}.json")) is not None:
        n, last = n + 1, connection_of(json.loads(held), stage)
        if _ended(last, cut):
            return n
        cursor = last["pageInfo"]["endCursor"]
    while True:
        data = client.execute(query, variables | {"cursor": cursor} | ({"since": since} if stage == "commits" and since else {}))
        with fs.open_output_stream(f"{base}/{stage}-{n}.json") as f:
            f.write(json.dumps(data).encode())
        n, found = n + 1, connection_of(data, stage)
        if _ended(found, cut):
            return n
        cursor = found["pageInfo"]["endCursor"]


def _ended(connection: dict | None, cut: datetime | None) -> bool:
    if connection is None or not (connection.get("pageInfo") or {}).get("hasNextPage"):
        return True
    nodes = connection.get("nodes") or []
    return cut is not None and bool(nodes) and all(is_late(n or {}, cut) for n in nodes)


def _store(path: str):
    """(file system, path in it) of any address that pyarrow opens."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(store, path: str) -> str | None:
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as f:
        return f.read().decode()


class PagesSource(DataSource):
    """Format "pages": cursor-paged JSON as a stream, one offset a page. Option `path`: a folder of <stage>-<n>.json files."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "stage string, number int, page string"

    def simpleStreamReader(self, schema):
        return PagesReader(self.options["path"], self.options["stage"])


class PagesReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, stage: str) -> None:
        self.path, self.stage = path, stage

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def _page(self, n: int) -> str | None:
        store, base = _store(self.path)
        return _read(store, f"{base}/{self.stage}-{n}.json")

    def read(self, start: dict):
        n, rows = start["cursor"], []
        if (page := self._page(n)) is not None:
            rows, n = [(self.stage, n, page)], n + 1
        return iter(rows), {"cursor": n}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(self.stage, n, self._page(n)) for n in range(start["cursor"], end["cursor"])])

    def commit(self, end: dict) -> None:
        """Pages are kept: the checkpoint holds the cursor."""


def _newest(nodes: list[dict]) -> datetime | None:
    """The latest time among a page's nodes: of update, or of commit."""
    times = [t for n in nodes if n and (t := instant(n.get("updatedAt") or n.get("committedDate")))]
    return max(times, default=None)


def _named(path: str) -> Callable:
    """The function of a path "module:name"."""
    module, name = path.split(":")
    return getattr(importlib.import_module(module), name)


class PullSource(DataSource):
    """Format "pull": pages asked of the service itself, as a batch or a stream, without a folder between.

    Options: transport ("module:name" of a PagedClient's send), token, stages (comma-separated) or stage, query.<stage>, variables
    (JSON), since (ISO). Of a page it gives stage, number, updated_at (of its newest node), cursor (of the next one) and page.
    """

    @classmethod
    def name(cls) -> str:
        return "pull"

    def schema(self) -> str:
        return "stage string, number int, updated_at timestamp, cursor string, page string"

    def reader(self, schema):
        return PullReader(dict(self.options))

    def simpleStreamReader(self, schema):
        return PullStream(dict(self.options))


class _Puller:
    def __init__(self, options: dict) -> None:
        self.options, self.since = options, instant(options.get("since"))
        self.stages = [x.strip() for x in (options.get("stages") or options.get("stage") or ",".join(PATHS)).split(",")]

    def page(self, stage: str, number: int, cursor: str | None) -> tuple[tuple, bool]:
        """(a page's row, whether it is the last that is wanted)."""
        client = PagedClient(_named(self.options["transport"]), self.options.get("token", ""))
        variables = json.loads(self.options.get("variables", "{}")) | {"cursor": cursor}
        if stage == "commits" and self.since:
            variables["since"] = self.since.isoformat()
        data = client.execute(self.options.get(f"query.{stage}", stage), variables)
        found = connection_of(data, stage)
        info = (found or {}).get("pageInfo") or {}
        newest = _newest((found or {}).get("nodes") or [])
        return (stage, number, newest, info.get("endCursor"), json.dumps(data)), _ended(found, self.since if stage != "commits" else None)


class PullReader(_Puller, DataSourceReader):
    """A stage is a partition: its pages follow one another, and stages are asked for side by side."""

    def pushFilters(self, filters: list[Filter]):
        """A lower bound on updated_at ends the paging; Spark tests the rows too."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("updated_at",) and isinstance(f.value, datetime):
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC)
                self.since = at if self.since is None else max(self.since, at)
            yield f

    def partitions(self):
        return [InputPartition(stage) for stage in self.stages]

    def read(self, partition):
        number, cursor, last = 0, None, False
        while not last:
            row, last = self.page(partition.value, number, cursor)
            number, cursor = number + 1, row[3]
            yield row


class PullStream(_Puller, SimpleDataSourceStreamReader):
    """A page a batch; the offset is the next page's cursor, so that a restart asks for no page before it."""

    def initialOffset(self) -> dict:
        return {"number": 0, "cursor": None, "ended": False}

    def read(self, start: dict):
        if start["ended"]:
            return iter([]), start
        row, last = self.page(self.stages[0], start["number"], start["cursor"])
        return iter([row]), {"number": start["number"] + 1, "cursor": row[3], "ended": last}

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = []
        while start["number"] < end["number"]:
            got, start = self.read(start)
            rows += got
        return iter(rows)

    def commit(self, end: dict) -> None:
        """The service keeps nothing of it."""


def register(spark: SparkSession) -> None:
    for source in (PagesSource, PullSource):
        spark.dataSource.register(source)


__all__ = ["PagedClient", "PagesSource", "PullSource", "fetch_pages", "nodes_of", "register"]
