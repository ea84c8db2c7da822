"""Nearest neighbours of many queries against brute force; recall of the graph index."""

import numpy as np
import pytest
from lodestrata.operators import neighbours as N
from pyspark.sql import functions as F


def brute(rows, queries, k):
    """{(q, r): vec_id} by double-precision cosine, ties by id."""
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, v = np.array([i for i, _ in ok]), np.array([x / np.linalg.norm(x) for _, x in ok])
    out = {}
    for q, x in queries:
        if x is None or not np.any(x):
            continue
        s = np.round(v @ (np.array(x, float) / np.linalg.norm(x)), N.DIGITS)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out |= {(q, r + 1): int(ids[i]) for r, i in enumerate(order)}
    return out


def clusters(n, dim=16, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(4, n // 40), dim))
    v = base[rng.integers(0, len(base), n)] + rng.normal(scale=spread, size=(n, dim))
    v[::9] = v[0]
    return [(i, x.tolist()) for i, x in enumerate(v)]


def frame(spark, rows, key="vec_id"):
    return spark.createDataFrame(rows, f"{key} long, embedding array<double>")


def answers(df):
    return {(r.q, r.r): r.vec_id for r in df.collect()}


@pytest.mark.parametrize("tile", [40, 10_000])
def test_exact_join(spark, tile):
    """Over many cells and tiles, with a third of the rows alike."""
    rows = clusters(1500)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    queries = [(i, v) for i, v in rows if i % 10 == 0]
    got = answers(N.nearest(frame(spark, rows), frame(spark, queries, "q"), 7, tile=tile))
    assert got == brute(rows, queries, 7)


def test_queries_from_elsewhere(spark):
    rng = np.random.default_rng(2)
    rows, queries = clusters(400), [(10_000 + i, rng.normal(size=16).tolist()) for i in range(50)]
    assert answers(N.nearest(frame(spark, rows), frame(spark, queries, "q"), 500, tile=50)) == brute(rows, queries, 500)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1e-300, 1e-300]), (10, [-1.0, 0.0])]
    queries = [(1, [1.0, 0.0]), (20, None), (21, [0.0, 0.0]), (22, [1.0, 1.0]), (None, [1.0, 0.0])]
    got = {(r.q, r.r): (r.vec_id, round(r.score, 6)) for r in N.nearest(frame(spark, rows), frame(spark, queries, "q"), 3).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (2, 1.0), (1, 3): (9, 0.707107), (22, 1): (9, 1.0), (22, 2): (1, 0.707107), (22, 3): (2, 0.707107)}
    none = frame(spark, [])
    assert N.nearest(none, frame(spark, queries, "q"), 3).count() == 0
    assert N.nearest(frame(spark, rows), frame(spark, [], "q"), 3).count() == 0
    assert N.nearest(frame(spark, [(1, [0.0, 0.0]), (2, None)]), frame(spark, queries, "q"), 3).count() == 0


def test_bounds_skip_cells_and_never_a_neighbour(spark):
    rows = clusters(3000, dim=8, spread=0.05)
    e = frame(spark, rows)
    space = N.fit(e, len(rows), 50)
    summary = N.summarise(N.place(e, "vec_id", space), space)
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = v @ space.axes.T
    cell, bound = space.of(y), summary.bounds(y[:200])
    assert summary.n.sum() == len(rows) and len(summary.cell) > 16
    real = np.array([[(y[i] @ y[cell == c].T).max() for c in summary.cell] for i in range(200)])
    assert (bound >= real).all()
    tenth = np.sort(y[:200] @ y.T, axis=1)[:, -11]
    assert (bound >= tenth[:, None]).mean() < 0.6, (bound >= tenth[:, None]).mean()


def test_links_reach_every_node():
    v = np.array([x for _, x in clusters(700, seed=5)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = N.link(v, 8, 1)
    seen, front = {0}, [0]
    while front:
        front = [int(b) for a in front for b in links[a] if b not in seen and not seen.add(int(b))]
    assert len(seen) == len(v) and max(len(x) for x in links) <= 18
    ids, s = N.walk(v, links, v[:50], ef=700)
    assert all(set(ids[i][np.isfinite(s[i])]) == set(range(700)) for i in range(50))


def recall(got, rows, queries, k):
    """Share of the k best cosines of each query that an answer's own reach: vectors alike are as good as each other."""
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    want, hit = brute(rows, queries, k), 0
    for q, _ in queries:
        least = min(v[q] @ v[want[q, r]] for r in range(1, k + 1))
        hit += sum(v[q] @ v[got[q, r]] >= least - 1e-9 for r in range(1, k + 1) if (q, r) in got)
    return hit / (k * len(queries))


def test_graph_index(spark, tmp_path):
    """Several shards a cell, few cells probed; and everything probed, which is exact."""
    rows = clusters(4000, dim=24, seed=3)
    queries = [(i, v) for i, v in rows if i % 20 == 0]
    N.build_graph_index(frame(spark, rows), str(tmp_path / "index"), shard=150, cells=16)
    index = N.read_graph_index(spark, str(tmp_path / "index"))
    assert index.nodes.count() == len(rows) and index.nodes.select("cell", "tile").distinct().count() > 16
    q = frame(spark, queries, "q")
    got = answers(N.graph_nearest(index, q, 10, probes=4, ef=40))
    assert recall(got, rows, queries, 10) >= 0.9
    assert answers(N.graph_nearest(index, q, 10, probes=16, ef=5000)) == brute(rows, queries, 10)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_tables(spark, tmp_path, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>"))
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    queries = [(i, v) for i, v in rows if i % 100 == 0]
    for shard in (128, N.SHARD):
        index = N.build_graph_index(e, str(tmp_path / f"{sf}-{shard}"), shard=shard)
        got = answers(N.graph_nearest(index, frame(spark, queries, "q"), 10))
        assert recall(got, rows, queries, 10) >= 0.9


def test_index_of_nothing(spark, tmp_path):
    assert N.build_graph_index(frame(spark, [(1, None)]), str(tmp_path / "none")) is None
