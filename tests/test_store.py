"""The bucketed store, history that resumes after a crash at any place, and pages pulled from the service."""

import json
import threading

import pytest
from lodestrata.plans.store import Store
from lodestrata.sources import history
from lodestrata.streaming.history import ingest_history
from pyspark.sql import functions as F

OLD = "2019-01-01T00:00:00+00:00"


def issues(spark, rows):
    """(number, title, updated) rows of repository 1."""
    made = [(1, n, 10 * n, t, None, "open", None, None, None, ["l"], None, u) for n, t, u in rows]
    return spark.createDataFrame(made, "repo_id long, number int, issue_id long, title string, body string, state string, author string, created_at timestamp, closed_at timestamp, labels array<string>, closing_pr_number int, __updated timestamp")


def titles(store):
    return {r.number: r.title for r in store.read("issue").collect()}


def test_a_small_batch_rewrites_its_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("s", "r", 0, {"issue": issues(spark, [(n, "old", None) for n in range(1000)])}, {"count": 1000})
    assert len(titles(store)) == 1000 and len(store.compact("issue")) == 64
    before = store.manifest()["tables"]["issue"]
    store.append("s", "r", 1, {"issue": issues(spark, [(n, "new", None) for n in range(0, 1000, 100)])}, {"count": 10})
    assert titles(store)[100] == "new"
    touched = store.compact("issue")
    after = store.manifest()["tables"]["issue"]
    assert 1 <= len(touched) <= 10 and {int(b) for b in after if after[b] != before[b]} == set(touched)
    got = titles(store)
    assert len(got) == 1000 and {n for n, t in got.items() if t == "new"} == set(range(0, 1000, 100))
    store.clean(1)
    assert titles(store) == got and store.state()["s"]["count"] == 1010


def test_the_latest_update_counts_and_replays_do_not(spark, tmp_path):
    store, at = Store(spark, str(tmp_path), 4), __import__("datetime").datetime
    newer, older = at(2024, 3, 1), at(2024, 2, 1)
    store.append("s", "r", 0, {"issue": issues(spark, [(1, "newer", newer)])}, {"count": 1})
    store.append("s", "r", 1, {"issue": issues(spark, [(1, "older", older)])}, {"count": 1})
    version = store.version()
    assert store.append("s", "r", 1, {"issue": issues(spark, [(1, "again", None)])}, {"count": 1})["count"] == 2 and store.version() == version
    assert titles(store) == {1: "newer"}
    store.compact("issue")
    assert titles(store) == {1: "newer"} and store.compact("issue") == []
    # another run's page 0 is another page
    store.append("s", "other run", 0, {"issue": issues(spark, [(2, "two", None)])}, {"count": 1})
    store.delete("issue", 1)
    assert titles(store) == {}
    with pytest.raises(RuntimeError, match="another writer"):
        store.put(store.version(), {})


def node(n, updated):
    return {"number": n, "title": f"t{n}", "state": "OPEN", "createdAt": "2024-01-01T00:00:00Z", "updatedAt": updated, "labels": {"nodes": []}, "comments": {"nodes": [{"databaseId": 100 + n, "body": "c", "createdAt": "2024-01-01T00:00:00Z"}]}}


def commit(n):
    return {"oid": f"sha{n}", "message": "m", "authoredDate": "2024-01-01T00:00:00Z", "committedDate": "2024-01-01T00:00:00Z", "parents": {"nodes": []}}


def body(stage, nodes, end=None):
    found = {"nodes": nodes, "pageInfo": {"hasNextPage": end is not None, "endCursor": end}}
    return {"repository": {"defaultBranchRef": {"target": {"history": found}}} if stage == "commits" else {{"pull_requests": "pullRequests", "issues": "issues"}[stage]: found}}


@pytest.mark.parametrize("crash", range(1, 7))
def test_a_crash_between_any_two_writes(spark, tmp_path, monkeypatch, crash):
    """The n-th commit of the manifest fails, after its data are written: the next call ends with the same rows and counts."""
    pages = tmp_path / "pages"
    pages.mkdir()
    for k in range(2):
        (pages / f"commits-{k}.json").write_text(json.dumps(body("commits", [commit(k)])))
        (pages / f"issues-{k}.json").write_text(json.dumps(body("issues", [node(k, "2024-02-01T00:00:00Z")])))
    real, calls = Store.put, []

    def put(self, version, manifest):
        calls.append(version)
        if len(calls) == crash:
            raise OSError("crashed")
        real(self, version, manifest)

    monkeypatch.setattr(Store, "put", put)
    where = str(pages), 1, str(tmp_path / "store"), str(tmp_path / "cp")
    try:
        first = ingest_history(spark, *where, since=OLD)["status"]
    except OSError:
        first = "failed"
    monkeypatch.setattr(Store, "put", real)
    # the window was the first that was written
    state = ingest_history(spark, *where, since=OLD if crash == 1 else None)
    assert first == "failed" and state["status"] == "done" and state["since"] == OLD
    assert [state[s].get("count", 0) for s in ("commits", "pull_requests", "issues")] == [2, 0, 2]
    store = Store(spark, where[2])
    assert {r.sha for r in store.read("commit").collect()} == {"sha0", "sha1"} and titles(store) == {0: "t0", 1: "t1"}
    assert sorted(r.github_id for r in store.read("comment").collect()) == [100, 101]


def test_default_window_and_progress(spark, tmp_path):
    from datetime import UTC, datetime

    pages, seen = tmp_path / "pages", []
    pages.mkdir()
    (pages / "issues-0.json").write_text(json.dumps(body("issues", [node(1, "2024-05-01T00:00:00Z"), node(2, "2023-01-01T00:00:00Z")])))
    state = ingest_history(spark, str(pages), 7, str(tmp_path / "store"), str(tmp_path / "cp"), now=datetime(2024, 6, 1, tzinfo=UTC), report=lambda *x: seen.append(x))
    assert state["since"] == "2023-06-07T00:00:00+00:00" and state["issues"]["count"] == 1
    for _ in range(100):
        if seen:
            break
        threading.Event().wait(0.1)
    assert ("issues", 0, 1) in seen


ASKED = "/tmp/lodestrata-asked"
PULLED = {
    "commits": [[commit(0)], [commit(1)]],
    "issues": [[node(5, "2024-05-01T00:00:00Z")], [node(4, "2024-04-01T00:00:00Z"), node(3, "2020-01-01T00:00:00Z")], [node(2, "2020-01-01T00:00:00Z")], [node(1, "2019-06-01T00:00:00Z")]],
    "pull_requests": [[]],
}


def send(query, variables, token):
    """A canned service: the query is the stage's name, the cursor a page's number; the token names the file of what was asked."""
    k = int(variables["cursor"] or 0)
    with open(token, "a") as f:
        f.write(f"{query} {k}\n")
    held = PULLED[query]
    return 200, {}, json.dumps({"data": body(query, held[k], str(k + 1) if k + 1 < len(held) else None)})


def test_pull_as_a_batch(spark, tmp_path):
    """A filter on time is pushed into the source: pages past the window are never asked for. A stage is a partition."""
    history.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        token = tmp_path / "asked"
        pull = spark.read.format("pull").option("transport", "tests.test_store:send").option("token", str(token)).option("stages", "issues,commits").load()
        assert pull.rdd.getNumPartitions() == 2
        token.write_text("")
        got = pull.where(F.col("updated_at") >= F.lit("2024-01-01").cast("timestamp")).select("stage", "number").collect()
        assert sorted(map(tuple, got)) == [("commits", 0), ("commits", 1), ("issues", 0), ("issues", 1)]
        assert "issues 2" in token.read_text() and "issues 3" not in token.read_text()
        nodes = history.nodes_of(pull.where("stage = 'issues'").withColumn("repo_id", F.lit(1)), "issues")
        assert sorted(r.number for r in nodes.select("node.number").collect()) == [1, 2, 3, 4, 5]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_pull_as_a_stream(spark, tmp_path):
    """The same source fills the store, a page a batch, and asks for nothing that it has."""
    token = tmp_path / "asked"
    source = {"format": "pull", "transport": "tests.test_store:send", "token": str(token), "since": "2023-01-01T00:00:00Z"}
    where = source, 1, str(tmp_path / "store"), str(tmp_path / "cp")
    state = ingest_history(spark, *where, since="2023-01-01T00:00:00Z")
    assert state["status"] == "done" and state["commits"]["count"] == 2 and state["issues"]["count"] == 2
    assert titles(Store(spark, where[2])) == {5: "t5", 4: "t4"}
    asked = token.read_text()
    assert "issues 3" not in asked
    ingest_history(spark, *where, again=True)
    assert token.read_text() == asked
