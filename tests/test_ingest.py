import json
import uuid

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph
from lodestrata.operators.chunking import chunk_files, chunk_python
from lodestrata.operators.citations import parse_answer
from lodestrata.plans import status
from lodestrata.plans.registry import PYTHON
from lodestrata.plans.upsert import insert_if_absent, recover_jobs, replace_partitions, upsert_table
from lodestrata.sources import history, tree
from lodestrata.plans.store import Store
from lodestrata.streaming.history import ingest_history


def test_scan_tree(spark, tmp_path):
    for name, body in {"src/main.py": b"def f():\n    pass\n", "README.md": b"\xff\xfe hi", "node_modules/x.js": b"x", ".git/HEAD": b"x", "logo.png": b"x", "big.txt": b"x" * 1048577}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    files = tree.scan_tree(spark, str(tmp_path), 7)
    rows = {r.path: r for r in files.collect()}
    assert set(rows) == {"src/main.py", "README.md"} and rows["src/main.py"].language == "Python" and "hi" in rows["README.md"].text
    assert [(c.chunk_type, c.name) for c in chunk_files(files).collect()] == [("function", "f")]
    with pytest.raises(ValueError, match="2 files"):
        tree.check_file_count(files, 1)


def test_chunk_python():
    got = [(c["chunk_type"], c["name"], c["start_line"], c["end_line"]) for c in chunk_python(PYTHON)]
    assert got == [("module_docstring", None, 1, 1), ("module_preamble", None, 2, 4), ("function", "f", 6, 8), ("function", "g", 10, 11), ("class", "C", 13, 16), ("method", "m", 17, 18), ("method", "p", 20, 22), ("top_level_block", None, 24, 25)]
    assert chunk_python(PYTHON)[2]["extra_metadata"]["decorators"] == ["cache(max=1)"] and chunk_python(PYTHON)[6]["extra_metadata"]["is_property"]
    assert chunk_python(PYTHON)[4]["content"].endswith("x = 1")
    assert chunk_python("def ok():\n    return 1\n\ndef bad(:\n") == [] or chunk_python("def ok():\n    return 1\n\ndef bad(:\n")[0]["name"] == "ok"
    assert "\r" not in chunk_python("def foo():\r\n    return 1\r\n")[0]["content"]
    assert [c["content"] for c in chunk_python("x = 'é'\ndef é():\n    return 'ü'\n")] == ["x = 'é'", "def é():\n    return 'ü'"]
    assert chunk_python("") == [] and chunk_python("def f(): pass\npass\n...\n# note\n")[-1]["content"] == "# note"


def test_parse_answer():
    got = lambda a: [(c["entity_type"], c["display_id"]) for c in parse_answer(a)["citations"]]
    assert got("[chunk:c1][pr:p2] [chunk:] [chunk: c1 ] [file:f1] [chunk:none]") == [("chunk", "c1"), ("pr", "p2"), ("chunk", "none")]
    assert got("````\n```\n[chunk:c1]\n````\n[chunk:c2]") == [("chunk", "c2")]
    assert got("`[chunk:c1]` ``a ` [chunk:c2]`` ` [chunk:c3]") == [("chunk", "c3")]
    assert parse_answer("~~~\n[chunk:c1]")["warnings"] == ["fence_unterminated"]


def commit_node(oid, message):
    return {"oid": oid, "message": message, "authoredDate": "2024-01-01T00:00:00Z", "committedDate": "2024-01-01T00:00:00Z", "author": {"name": "a", "email": "e"}, "additions": 1, "deletions": 0, "changedFilesIfAvailable": 1, "parents": {"nodes": [{"oid": "p"}]}}


def page(stage, nodes):
    body = {"nodes": nodes, "pageInfo": {"hasNextPage": False, "endCursor": None}}
    return json.dumps({"repository": {"defaultBranchRef": {"target": {"history": body}}}} if stage == "commits" else {"repository": {{"pull_requests": "pullRequests", "issues": "issues"}[stage]: body}})


PR = {"number": 1, "title": "T", "body": "closes #2", "state": "MERGED", "author": None, "createdAt": "2024-01-01T00:00:00Z", "updatedAt": "2024-02-01T00:00:00Z", "mergedAt": "2024-01-02T00:00:00Z", "mergeCommit": {"oid": "aaa"}, "comments": {"nodes": [{"databaseId": 5, "body": "c", "author": {"login": "x"}, "createdAt": "2024-01-01T00:00:00Z"}]}, "reviews": {"nodes": [{"databaseId": 6, "body": "r", "createdAt": "2024-01-01T00:00:00Z"}, {"databaseId": 7, "body": " \n", "createdAt": "2024-01-01T00:00:00Z"}]}}
ISSUE = {"number": 2, "title": "I", "body": None, "state": "OPEN", "createdAt": "2024-01-01T00:00:00Z", "updatedAt": "2020-01-01T00:00:00Z", "labels": {"nodes": [{"name": "bug"}, {"name": "p1"}]}, "comments": {"nodes": []}}


def test_history_stream(spark, tmp_path):
    pages, out, cp = tmp_path / "pages", str(tmp_path / "t"), str(tmp_path / "cp")
    pages.mkdir()
    (pages / "commits-0.json").write_text(page("commits", [commit_node("aaa", "one"), commit_node("bbb", "two")]))
    (pages / "pull_requests-0.json").write_text(page("pull_requests", [PR]))
    (pages / "issues-0.json").write_text(page("issues", [ISSUE]))
    old = "2019-01-01T00:00:00+00:00"
    state = ingest_history(spark, str(pages), 1, out, cp, since=old)
    assert state["status"] == "done" and [state[s]["count"] for s in ("commits", "pull_requests", "issues")] == [2, 1, 1]
    (pages / "commits-1.json").write_text(page("commits", [commit_node("aaa", "edited"), commit_node("ccc", "three")]))
    # what is done is not read again, unless that is asked for; the window stays
    assert ingest_history(spark, str(pages), 1, out, cp)["commits"]["count"] == 2
    again = ingest_history(spark, str(pages), 1, out, cp, again=True)
    assert again["commits"]["count"] == 4 and again["since"] == old and again["issues"]["count"] == 1
    rows = {r.sha: r for r in Store(spark, out).read("commit").collect()}
    assert len(rows) == 3 and rows["aaa"].message == "edited" and rows["bbb"].parent_shas == ["p"]
    issue = Store(spark, out).read("issue").first()
    assert (issue.state, issue.labels) == ("open", ["bug", "p1"])
    (pages / "commits-2.json").write_text("{}")
    assert ingest_history(spark, str(pages), 1, out, cp, again=True)["commits"]["count"] == 4


def test_history_to_graph(spark, tmp_path):
    """Pages to tables with ids, comments and the latest of several versions, and on to the graph's edges."""
    from lodestrata.plans.ingest import build_graph

    pages, out, cp = tmp_path / "pages", str(tmp_path / "t"), str(tmp_path / "cp")
    pages.mkdir()
    (pages / "commits-0.json").write_text(page("commits", [commit_node("aaa", "one")]))
    newer = {**PR, "title": "A newer", "updatedAt": "2024-03-01T00:00:00Z"}
    (pages / "pull_requests-0.json").write_text(page("pull_requests", [newer]))
    (pages / "pull_requests-1.json").write_text(page("pull_requests", [PR]))
    (pages / "issues-0.json").write_text(page("issues", [ISSUE]))
    assert ingest_history(spark, str(pages), 1, out, cp, since="2019-01-01T00:00:00Z")["status"] == "done"
    commits, prs, issues, said = (Store(spark, out).read(t) for t in ("commit", "pull_request", "issue", "comment"))
    assert prs.first().title == "A newer"
    assert sorted((r.number, r.github_id, r.comment_type) for r in said.collect()) == [(1, 5, "issue_comment"), (1, 6, "review_body")]
    none = lambda s: spark.createDataFrame([], s)
    chunks, files = none("repo_id long, chunk_id long, file_id long, start_line int"), none("file_id long, path string")
    built = build_graph(chunks, files, none("repo_id long, path string, line int, sha string"), commits, prs, issues)
    assert sorted(r.edge_type for r in built["edges"].collect()) == ["closed_by", "part_of", "references_issue"]
    assert built["issues"].first().closing_pr_number == 1


def test_fetch_pages(spark, tmp_path):
    """Paging follows the cursor, resumes after the last page stored and ends at a page that is late as a whole."""
    def body(n, times, more=True):
        nodes = [{"number": 10 * n + i, "updatedAt": t} for i, t in enumerate(times)]
        return {"repository": {"issues": {"nodes": nodes, "pageInfo": {"hasNextPage": more, "endCursor": f"c{n}"}}}}

    new, old = "2024-05-01T00:00:00Z", "2020-01-01T00:00:00Z"
    answers = {None: body(0, [new, new]), "c0": body(1, [new, old]), "c1": body(2, [old, None]), "c2": body(3, [old])}
    asked = []

    class Client:
        fails = True

        def execute(self, query, variables):
            asked.append(variables["cursor"])
            if self.fails and len(asked) == 2:
                raise RuntimeError("down")
            return answers[variables["cursor"]]

    client, to = Client(), str(tmp_path / "pages")
    with pytest.raises(RuntimeError):
        history.fetch_pages(client, "q", {}, "issues", to, "2024-01-01T00:00:00Z")
    client.fails = False
    assert history.fetch_pages(client, "q", {}, "issues", to, "2024-01-01T00:00:00Z") == 3
    assert asked == [None, "c0", "c0", "c1"]
    assert history.fetch_pages(client, "q", {}, "issues", to, "2024-01-01T00:00:00Z") == 3 and len(asked) == 4
    answers[None] = {"repository": None}
    assert history.fetch_pages(client, "q", {}, "issues", str(tmp_path / "none")) == 1


def test_rate_limit_reset():
    slept = []
    data = {"data": {"rateLimit": {"remaining": 3, "resetAt": "1970-01-01T00:02:00Z"}}}
    client = history.PagedClient(lambda *_: (200, {}, json.dumps(data)), "t", sleep=slept.append, now=lambda: 100.0)
    client.execute("q", {})
    data["data"]["rateLimit"]["remaining"] = 51
    client.execute("q", {})
    assert slept == [20.0]


def test_history_rows(spark):
    pages = spark.createDataFrame([(1, page("pull_requests", [PR]))], "repo_id long, page string")
    nodes = history.nodes_of(pages, "pull_requests")
    pr = history.pull_requests(nodes).first()
    assert (pr.state, pr.merge_commit_sha, pr.author) == ("merged", "aaa", None)
    both = history.comments(nodes).unionByName(history.comments(nodes, reviews=True))
    assert sorted((r.github_id, r.comment_type) for r in both.collect()) == [(5, "issue_comment"), (6, "review_body")]
    assert history.within(nodes, F.lit("2024-03-01").cast("timestamp")).count() == 0


def test_client():
    slept, answers = [], [(502, {}, ""), OSError("down"), (200, {}, json.dumps({"data": {"x": 1}}))]

    def send(*_):
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    assert history.PagedClient(send, "t", sleep=slept.append).execute("q", {}) == {"x": 1} and slept == [1.0, 2.0]
    limited = "You have exceeded a secondary rate limit."
    for headers, wait in (({"X-RateLimit-Reset": "130"}, 30.0), ({"x-ratelimit-reset": "soon"}, 60.0), ({}, 60.0), ({"x-ratelimit-reset": "5"}, 1.0), ({"x-ratelimit-reset": "99999"}, 3600.0)):
        answers[:] = [(403, headers, limited), (200, {}, '{"data": null}')]
        assert history.PagedClient(send, "t", sleep=slept.append, now=lambda: 100.0).execute("q", {}) == {} and slept[-1] == wait
    for status in (401, 403):
        answers[:] = [(status, {"x-ratelimit-remaining": "0"}, "no scope")]
        with pytest.raises(history.AuthError):
            history.PagedClient(send, "t").execute("q", {})
    answers[:] = [(404, {}, "gone")]
    with pytest.raises(history.QueryError, match="404"):
        history.PagedClient(send, "t").execute("q", {})
    for last in ((503, {}, "down"), (403, {}, limited), OSError("down")):
        answers[:] = [last] * 4
        with pytest.raises((history.QueryError, OSError)):
            history.PagedClient(send, "t", sleep=slept.append).execute("q", {})
        assert not answers
    answers[:] = [(200, {}, '{"errors": [{"message": "no"}]}')]
    with pytest.raises(RuntimeError, match="no"):
        history.PagedClient(send, "t").execute("q", {})


def test_upserts(spark, tmp_path):
    schema = "repo_id int, number int, title string, body string, state string, author string, closed_at timestamp, labels array<string>"
    old = spark.createDataFrame([(1, 1, "a", "b", "open", "x", None, []), (1, 2, "k", None, "open", "y", None, [])], schema)
    new = spark.createDataFrame([(1, 1, "A", None, "closed", "z", None, ["l"]), (1, 3, "n", None, "open", "q", None, [])], schema)
    rows = {r.number: r for r in upsert_table(old, new, "issue").collect()}
    assert (rows[1].title, rows[1].body, rows[1].author) == ("A", None, "x") and rows[2].title == "k" and rows[3].author == "q"
    assert sorted(upsert_table(upsert_table(old, new, "issue"), new, "issue").collect()) == sorted(rows.values())
    stub = spark.createDataFrame([(1, 1, "stub"), (1, 9, "stub")], "repo_id int, number int, title string")
    assert {r.number: r.title for r in insert_if_absent(old, stub, ["repo_id", "number"]).collect()} == {1: "a", 2: "k", 9: "stub"}
    jobs = spark.createDataFrame([("in_progress",), ("done",)], "status string")
    assert [r.status for r in recover_jobs(jobs).collect()] == ["failed", "done"]
    path = str(tmp_path / "p")
    part = lambda *v: spark.createDataFrame(list(v), "t string, x int")
    replace_partitions(part(("a", 1), ("b", 2)), path, ["t"])
    replace_partitions(part(("a", 3)), path, ["t"])
    replace_partitions(part().limit(0), path, ["t"])
    assert sorted((r.t, r.x) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_edges(spark):
    prs = spark.createDataFrame([(1, 1, 234, "x", "closes #42", "2024-01-01", "s1", None), (1, 2, 235, "references #42", None, None, None, None), (1, 3, 236, "fixes #9999", None, "2024-01-01", "s1", None)], "repo_id int, pr_id long, number int, title string, body string, merged_at string, merge_commit_sha string, z string")
    issues = spark.createDataFrame([(1, 7, 42, None)], "repo_id int, issue_id long, number int, closing_pr_number int")
    references, closed, noted = graph.pr_issue_links(prs, issues)
    assert references.count() == closed.count() == 1 and noted.first().closing_pr_number == 234
    commits = spark.createDataFrame([(1, 5, "s1"), (1, 6, "s2")], "repo_id int, commit_id long, sha string")
    assert [(r.source_id, r.target_id) for r in graph.part_of(commits, prs).collect()] == [(5, 3)]
    chunks = spark.createDataFrame([(1, 11, 1, 1), (1, 12, 1, 4)], "repo_id int, chunk_id long, file_id long, start_line int")
    files = spark.createDataFrame([(1, "a.py")], "file_id long, path string")
    blame = spark.createDataFrame([(1, "a.py", 1, "s1"), (1, "a.py", 4, "new")], "repo_id int, path string, line int, sha string")
    edges, unknown = graph.introduced_by(chunks, files, blame, commits)
    assert [(r.source_id, r.target_id, r.edge_metadata.blame_line) for r in edges.collect()] == [(11, 5, 1)] and [r.sha for r in unknown.collect()] == ["new"]
    assert graph.insert_edges(edges, edges).count() == 0
    stub = spark.createDataFrame([("abc\0n\0\0002024-01-01T00:00:00Z\0002024-01-02T00:00:00Z\0msg\n\n",), ("bad",)], "raw string").select(tree.parse_commit_stub(F.col("raw")).alias("s")).collect()
    assert stub[0].s.message == "msg" and stub[0].s.author_email is None and stub[0].s.committed_at.day == 2 and stub[1].s is None


def test_page_limits(spark):
    with pytest.raises(ValueError, match="limit"):
        status.chunk_page(spark.range(1), 501)


def test_write_path(spark, tmp_path):
    import subprocess

    from lodestrata.plans import ingest

    root, store = tmp_path / "r", str(tmp_path / "store")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first\n\nbody")
    url = "https://github.com/o/r"
    for _ in range(2):
        assert ingest.ingest_repo(spark, url, store, 1, str(root))["files"] == 1
    with pytest.raises(ValueError, match="address"):
        ingest.ingest_repo(spark, "http://x", store, 1, str(root))
    chunks, files = (spark.read.parquet(f"{store}/{t}") for t in ("chunk", "file"))
    assert chunks.count() == 1
    blame = tree.blame(files, str(root))
    assert blame.count() == 2
    empty = lambda s: spark.createDataFrame([], s)
    commits = empty("repo_id long, commit_id long, sha string, author_name string, author_email string, authored_at timestamp, message string")
    prs = empty("repo_id long, pr_id long, number int, title string, body string, merged_at timestamp, merge_commit_sha string")
    issues = empty("repo_id long, issue_id long, number int, title string, body string, closing_pr_number int")
    built = ingest.build_graph(chunks, files, blame, commits, prs, issues, lambda s: tree.commit_stubs(s, str(root)))
    assert built["edges"].count() == 1 and built["commits"].first().message == "first\n\nbody"
    ingest.embed_repo(ingest.texts_to_embed(chunks, built["commits"], prs, issues), store, 16)
    ingest.embed_repo(ingest.texts_to_embed(chunks, None, None, None), store, 16)
    got = spark.read.parquet(f"{store}/embedding").collect()
    assert sorted(r.entity_type for r in got) == ["chunk", "commit"] and all(len(r.embedding) == 16 for r in got)


def test_schemas(spark):
    from lodestrata import schemas

    chunk = chunk_files(spark.createDataFrame([(0, 1, "Python", PYTHON)], "repo_id long, file_id long, language string, text string"))
    assert schemas.conform(chunk, "chunk").schema.simpleString() == schemas.schema("chunk").simpleString() and schemas.conform(chunk, "chunk").count() == 8
    assert all(schemas.schema(t).names[0] == "repo_id" for t in schemas.TABLES)


def test_replace_drops_what_hung_on_it(spark, tmp_path):
    """A tree without chunks leaves none, nor embeddings and edges of former ones; another repository's rows stay."""
    from lodestrata.plans import ingest

    root, store = tmp_path / "r", str(tmp_path / "store")
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n")
    (root / "logo.png").write_bytes(b"x" * 10)
    for repo in (1, 2):
        assert ingest.ingest_repo(spark, "https://github.com/o/r", store, repo, str(root))["chunk_error"] is None
    chunks = spark.read.parquet(f"{store}/chunk")
    got = ingest.embed_repo(ingest.texts_to_embed(chunks, None, None, None), store, 8)
    assert got == {"chunk": {"embedded": 2, "skipped": 0, "error": None}}
    (root / "a.py").unlink()
    (root / "b.txt").write_text("plain")
    assert ingest.ingest_repo(spark, "https://github.com/o/r", store, 1, str(root))["files"] == 1
    left = lambda t: {r.repo_id for r in spark.read.parquet(f"{store}/{t}").select("repo_id").collect()}
    assert left("chunk") == {2} and left("embedding") == {2} and left("file") == {1, 2} and left("repo") == {1, 2}


def test_replace_takes_all_of_a_repository(spark, tmp_path):
    """History, edges, postings and embeddings of every kind go with a new ingest; another repository's stay; history starts anew."""
    from lodestrata.plans import ingest

    root, store, pages = tmp_path / "r", str(tmp_path / "store"), tmp_path / "pages"
    root.mkdir()
    pages.mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n")
    (pages / "commits-0.json").write_text(page("commits", [commit_node("aaa", "one")]))
    (pages / "issues-0.json").write_text(page("issues", [ISSUE]))
    history_of = lambda repo: ingest_history(spark, str(pages), repo, f"{store}/history", f"{store}/checkpoint/{repo}", since="2019-01-01T00:00:00Z")
    for repo in (1, 2):
        ingest.ingest_repo(spark, "https://github.com/o/r", store, repo, str(root))
        assert history_of(repo)["commits"]["count"] == 1
        made = spark.createDataFrame([(repo, 5, "text")], "repo_id long, entity_id long, text string")
        ingest.embed_repo({k: made for k in ("chunk", "commit", "issue")}, store, 4)
        edge = spark.createDataFrame([(repo, "part_of")], "repo_id long, edge_type string").withColumn("source_id", F.lit(1))
        edge.write.mode("append").partitionBy("repo_id", "edge_type").parquet(f"{store}/edge")
    ingest.ingest_repo(spark, "https://github.com/o/r", store, 1, str(root))
    kept = Store(spark, f"{store}/history")
    assert {r.repo_id for t in ("commit", "issue") for r in kept.read(t).collect()} == {2}
    left = lambda t: {r.repo_id for r in spark.read.parquet(f"{store}/{t}").select("repo_id").collect()}
    assert left("embedding") == left("edge") == {2} and left("chunk") == left("file") == left("repo") == {1, 2}
    assert history_of(1)["commits"]["count"] == 1 and {r.repo_id for r in kept.read("commit").collect()} == {1, 2}


def test_an_embedding_job_that_embeds_nothing_has_failed(spark, tmp_path):
    from lodestrata.plans import ingest, jobs

    def embed(texts):
        raise RuntimeError("no")

    texts = {"chunk": spark.createDataFrame([(1, 5, "text")], "repo_id long, entity_id long, text string")}
    got = ingest.embed_job(spark, texts, str(tmp_path), 1, dim=4, embed=ingest.batched(embed))
    assert got["status"] == "failed" and "none of 1 rows" in got["error"]
    assert ingest.embed_job(spark, texts, str(tmp_path), 1, dim=4)["status"] == "done"
    assert ingest.embed_job(spark, {"chunk": texts["chunk"].limit(0)}, str(tmp_path), 1, dim=4)["status"] == "done"
    assert jobs.status(spark, str(tmp_path), 1, "embedding")["progress"] == 1.0


def test_a_job_is_claimed_once(spark, tmp_path, monkeypatch):
    """Eight callers at once: one does the work, however late the others come."""
    import threading

    from lodestrata import tables
    from lodestrata.plans import jobs

    did, together, asked = [], threading.Barrier(8), threading.Semaphore(0)
    real = tables.create

    def create(*a):
        got = real(*a)
        asked.release()
        return got

    monkeypatch.setattr(jobs, "create", create)

    def work(report):
        did.append(1)
        # until all have asked
        assert all(asked.acquire(timeout=60) for _ in range(8))

    def call():
        together.wait()
        jobs.run(spark, str(tmp_path), 1, "graph", work)

    threads = [threading.Thread(target=call) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert did == [1] and jobs.status(spark, str(tmp_path), 1, "graph")["status"] == "done"


def test_batches_that_fail(spark, tmp_path):
    from lodestrata.plans import ingest

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    chunks = spark.createDataFrame([(1, i, "bad" if i == 5 else "x" * i) for i in range(1, 9)], "repo_id long, chunk_id long, content string").coalesce(1)
    got = ingest.embed_repo(ingest.texts_to_embed(chunks, None, None, None), str(tmp_path), 1, ingest.batched(embed, 2))
    assert got["chunk"] == {"embedded": 6, "skipped": 2, "error": None}
    assert sorted(r.entity_id for r in spark.read.parquet(f"{tmp_path}/embedding").collect()) == [1, 2, 3, 4, 7, 8]


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    """Eight tasks of several Arrow batches each: as many loads as worker processes, and 32 texts a call."""
    import os

    from lodestrata.plans import ingest

    told = str(tmp_path / "told")

    def load():
        with open(told, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def embed(texts):
            with open(told, "a") as f:
                f.write(f"call {len(texts)}\n")
            return [[float(len(t)), float(os.getpid())] for t in texts]

        return embed

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "96")
    try:
        texts = spark.range(0, 8 * 320, 1, 8).select(F.lit(1).cast("long").alias("repo_id"), F.col("id").alias("entity_id"), F.repeat(F.lit("x"), (F.col("id") % 7 + 1).cast("int")).alias("text"))
        got = ingest.embed_repo({"chunk": texts}, str(tmp_path / "store"), 2, ingest.batched(load=load, name=told))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["chunk"] == {"embedded": 2560, "skipped": 0, "error": None}
    lines = open(told).read().split("\n")[:-1]
    loads, calls = [x for x in lines if x[:4] == "load"], [int(x[5:]) for x in lines if x[:4] == "call"]
    assert len(loads) == len(set(loads)) <= 8 and sum(calls) == 2560 and max(calls) == 32 and len(calls) == 80
    rows = spark.read.parquet(f"{tmp_path}/store/embedding").collect()
    assert {f"load {int(r.embedding[1])}" for r in rows} <= set(loads) and all(r.embedding[0] == r.entity_id % 7 + 1 for r in rows)


def test_jobs(spark, tmp_path):
    from lodestrata.plans import jobs

    store, seen = str(tmp_path), []
    assert jobs.status(spark, store, 1, "graph")["status"] == "pending"

    def work(report):
        report(0.5)
        seen.append(jobs.status(spark, store, 1, "graph"))
        assert jobs.run(spark, store, 1, "graph", lambda r: 1 / 0)["status"] == "in_progress"

    assert jobs.run(spark, store, 1, "graph", work)["status"] == "done" and (seen[0]["status"], seen[0]["progress"]) == ("in_progress", 0.5)
    failed = jobs.run(spark, store, 2, "graph", lambda r: 1 / 0)
    assert failed["status"] == "failed" and failed["error"].startswith("ZeroDivisionError") and failed["completed_at"]

    def dies(report):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        jobs.run(spark, store, 3, "graph", dies)
    assert {(r.repo_id, r.status) for r in jobs.recover(spark, store).collect()} == {(1, "done"), (2, "failed"), (3, "failed")}


def test_tables_made_once(spark, tmp_path):
    from lodestrata import tables

    made, name = [], f"test-{uuid.uuid4().hex}"

    def make():
        made.append(1)
        return {"t": (spark.range(5), lambda df, path: df.write.parquet(path))}

    for _ in range(2):
        assert tables.kept(spark, name, {"t": "id bigint"}, make)["t"].count() == 5
    assert len(made) == 1
    (tmp_path / "a").write_text("x")
    before = tables.fingerprint(spark, str(tmp_path))
    (tmp_path / "a").write_text("xy")
    assert tables.fingerprint(spark, str(tmp_path)) != before
