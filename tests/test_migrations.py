"""An older store is read, moved up and down; a crash at any rename loses nothing."""

import pytest
from lodestrata import schemas
from lodestrata.plans import migrations as M

LAST = M.STEPS[-1].number


@pytest.fixture
def store(spark, tmp_path):
    """Tables of the first shape."""
    path = str(tmp_path / "store")
    put = lambda rows, ddl, name: spark.createDataFrame(rows, ddl).write.partitionBy("repo_id").parquet(f"{path}/{name}")
    put([(1, "o", "r"), (2, "o", "s")], "repo_id long, owner string, name string", "repo")
    put([(1, 10, [1.0, 0.0], "m"), (2, 20, [0.0, 1.0], "m")], "repo_id long, chunk_id long, embedding array<float>, model_name string", "chunk_embedding")
    put([(1, 5, "sha", "2024-01-01 00:00:00")], "repo_id long, commit_id long, sha string, authored_at string", "commit")
    put([(1, 10, 3, "function", "f", None, 1, 2, "x", "Python")], "repo_id long, chunk_id long, file_id long, chunk_type string, name string, parent_name string, start_line int, end_line int, content string, language string", "chunk")
    return path


def rows(df):
    return sorted(map(str, df.collect()))


def test_up_and_down(spark, store):
    tables = ("repo", "embedding", "commit", "chunk")
    old = {t: rows(spark.read.parquet(f"{store}/{t}")) for t in ("repo", "chunk_embedding", "commit", "chunk")}
    before = {t: rows(M.read(spark, store, t)) for t in tables}
    assert M.version(spark, store) == 0 and "entity_type='chunk'" in before["embedding"][0]
    assert M.migrate(spark, store) == [(n, "up") for n in range(1, LAST + 1)] and M.migrate(spark, store) == []
    for t in tables:
        assert rows(M.read(spark, store, t)) == before[t]
        assert set(spark.read.parquet(f"{store}/{t}").columns) <= set(schemas.schema(t).names)
    assert spark.read.parquet(f"{store}/commit").first().committed_at is not None
    assert M.migrate(spark, store, 1) == [(n, "down") for n in range(LAST, 1, -1)] and M.version(spark, store) == 1
    assert rows(spark.read.parquet(f"{store}/chunk_embedding")) == old["chunk_embedding"]
    M.migrate(spark, store, 0)
    assert {t: rows(spark.read.parquet(f"{store}/{t}")) for t in old} == old
    assert len(M.log(spark, store)) == 2 * LAST
    M.migrate(spark, store)
    assert {t: rows(M.read(spark, store, t)) for t in tables} == before


@pytest.mark.parametrize("crash", range(1, 8))
def test_a_crash_at_any_place(spark, store, monkeypatch, crash):
    """The n-th write to the log or removal fails: the next call ends as if nothing had been."""
    tables, calls = ("repo", "embedding", "commit", "chunk"), []
    want = {t: rows(M.read(spark, store, t)) for t in tables}

    def failing(real):
        def f(*a):
            calls.append(real)
            if len(calls) == crash:
                raise OSError("crashed")
            return real(*a)

        return f

    real = M.remove, M._note
    monkeypatch.setattr(M, "remove", failing(real[0]))
    monkeypatch.setattr(M, "_note", failing(real[1]))
    with pytest.raises(OSError):
        M.migrate(spark, store)
    monkeypatch.setattr(M, "remove", real[0])
    monkeypatch.setattr(M, "_note", real[1])
    M.migrate(spark, store)
    assert M.version(spark, store) == LAST and {t: rows(M.read(spark, store, t)) for t in tables} == want


def test_between_two_renames(spark, store):
    """The table is away under its old name, its rewrite is whole under another: it is put back."""
    import shutil

    want = rows(M.read(spark, store, "repo"))
    shutil.move(f"{store}/repo", f"{store}/repo--old-x")
    shutil.copytree(f"{store}/repo--old-x", f"{store}/repo--y")
    M.migrate(spark, store)
    assert rows(M.read(spark, store, "repo")) == want
