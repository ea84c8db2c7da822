"""Operator 8 against brute force: sizes apart, magnitudes, the threshold itself, cells, guests and blocks."""

import numpy as np
import pytest
from lodestrata.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows, threshold=0.98):
    """n_links and component_id by all pairs."""
    links = {i: set() for i in range(len(rows))}
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la == lb and len(a) == len(b):
                x, y = (np.array(v) / np.abs(v).max() for v in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    root, out = {}, []
    for i in links:
        if i not in root:
            todo, seen = [i], {i}
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            root |= dict.fromkeys(seen, min(rows[k][0] for k in seen))
        out.append((rows[i][0], len(links[i]), root[i]))
    return sorted(out)


def run(spark, rows, **options):
    got = embeddings.near_vectors(spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], SCHEMA), **options).collect()
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got)


def cloud(rng, n, dim, centres, scale):
    base = rng.normal(size=(centres, dim))
    return base[rng.integers(0, centres, n)] + rng.normal(scale=scale, size=(n, dim))


def test_sizes_and_magnitudes(spark):
    """Each size with its own; components of 1e200 and 1e-200 neither overflow nor vanish."""
    rng = np.random.default_rng(2)
    vs = [*cloud(rng, 60, 12, 8, 0.05), *cloud(rng, 40, 3, 5, 0.05), *cloud(rng, 9, 1, 2, 0.1)]
    rows = [(i, v * (1e200, 1e-200, 1.0, 3e-5)[i % 4], "ab"[i % 7 == 0]) for i, v in enumerate(vs)]
    want = plain(rows)
    assert run(spark, rows) == want and sum(n > 0 for _, n, _ in want) > 60


def test_threshold(spark):
    """A pair just under 0.98 isn't linked, one just over is."""
    at = lambda c: [c, np.sqrt(1 - c * c)]
    rows = [(0, [1.0, 0.0], "a"), (1, at(0.98 - 5e-10), "a"), (10, [1.0, 0.0], "b"), (11, at(0.98 + 5e-10), "b")]
    assert run(spark, rows) == [(0, 0, 0), (1, 0, 1), (10, 1, 10), (11, 1, 10)]


@pytest.mark.parametrize("dim, tile", [(2, 16), (4, 64), (20, 32)])
def test_cells_and_blocks(spark, dim, tile):
    """A label far larger than a block, with a dense heap, a long chain and loose vectors."""
    rng = np.random.default_rng(dim)
    turn = np.linspace(0, 2, 90)
    chain = np.zeros((90, dim))
    chain[:, 0], chain[:, 1] = np.cos(turn), np.sin(turn)
    heap = rng.normal(size=dim) + rng.normal(scale=0.01, size=(120, dim))
    vs = np.concatenate([cloud(rng, 250, dim, 60, 0.08), chain, heap, rng.normal(size=(60, dim))])
    rows = [(int(i), v, "l" if i % 5 else "m") for i, v in zip(rng.permutation(len(vs)), vs)]
    assert run(spark, rows, tile=tile) == plain(rows)


def test_bounds_before_the_shuffle(spark, monkeypatch):
    """In a dense cell a vector is sent to the blocks of near parts alone; the links are those of all pairs."""
    rng = np.random.default_rng(6)
    turn = rng.uniform(0, 0.3, 1000)
    v = rng.normal(scale=0.0005, size=(1000, 6))
    v[:, 0] += np.cos(turn)
    v[:, 1] += np.sin(turn)
    v[::50] = v[0]
    rows = [(i, x, "l") for i, x in enumerate(v)]
    sent, real = [], embeddings._block_pairs

    def seen(*a):
        out = real(*a)
        sent.extend(r["count"] for r in out.groupBy("node", "c0", "c1", "c2").count().collect())
        return out

    monkeypatch.setattr(embeddings, "_block_pairs", seen)
    assert run(spark, rows, threshold=0.99999, tile=16) == plain(rows, 0.99999)
    assert len(sent) > 500 and max(sent) <= 8
