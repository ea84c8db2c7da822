"""Nearest neighbours by cosine of many queries at once: an exact join of blocks, and an index of small-world graphs.

Both part space into cells, and look at vectors along principal axes. Axes and centres of cells are fitted on a bounded sample
and say only where a vector is kept; the exact join skips what a bound over all of a cell's vectors rules out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.tables import stash

#: Vectors that the cells are fitted on; cells at most; leading axes of a bound; rows of a block and of a graph.
SAMPLE, CELLS, LEADING, TILE, SHARD = 10_000, 1024, 16, 8192, 8192
#: Cosines are equal up to so many digits; then the smaller id is nearer.
DIGITS = 12


def units(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a direction, their unit vectors): not null, of `dim` finite components, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    dim = int(size.max(initial=0)) if dim is None else dim
    ok = (size == dim) & (dim > 0)
    v = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if ok.any() else np.zeros((0, dim))
    with np.errstate(all="ignore"):
        # by the largest component first, so that no square overflows
        v = v / np.abs(v).max(axis=1, initial=0, keepdims=True)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
    fine = np.isfinite(v).all(axis=1)
    ok[np.flatnonzero(ok)[~fine]] = False
    return ok, v[fine]


@dataclass(frozen=True)
class Cells:
    """Principal axes (rows, largest share first) and, along them, centres: a vector's cell is that of the centre nearest by cosine."""

    axes: np.ndarray
    centres: np.ndarray

    @property
    def dim(self) -> int:
        return self.axes.shape[1]

    def of(self, turned: np.ndarray) -> np.ndarray:
        """The cell of each vector, given along the axes."""
        return (turned @ self.centres.T).argmax(axis=1)


def fit(embeddings: DataFrame, rows: int, per_cell: int, sample: int = SAMPLE, most: int = CELLS, rounds: int = 8) -> Cells | None:
    """Cells for a table of `rows` vectors, some `per_cell` each, from the `sample` rows of smallest hash of vec_id. None: no vector.

    Centres are those of spherical k-means over the sample.
    """
    few = embeddings.where(F.size("embedding") > 0).orderBy(F.xxhash64(F.col("vec_id").cast("long")), "vec_id").limit(sample).select("embedding")
    ok, v = units(few.toArrow().column(0))
    if not len(v):
        return None
    _, _, axes = np.linalg.svd(v, full_matrices=True)
    y = v @ axes.T
    n = int(min(most, max(1, len(v) // 8), -(-rows // per_cell)))
    centres = y[np.random.default_rng(0).choice(len(y), n, replace=False)]
    for _ in range(rounds):
        cell = (y @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, y)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return Cells(axes, centres)


def place(rows: DataFrame, key: str, cells: Cells, extra: Callable[[np.ndarray], dict[str, list]] | None = None, more: str = "") -> DataFrame:
    """(key, embedding, cell, and what `extra` makes of the turned vectors) of the rows that have a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, v = units(batch.column(1), cells.dim)
            y = v @ cells.axes.T
            kept = batch.filter(pa.array(ok))
            added = extra(y) if extra else {}
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cells.of(y), pa.int32()), *[pa.array(x) for x in added.values()]], names=[key, "embedding", "cell", *added])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select(F.col(key).cast("long"), "embedding").mapInArrow(run, f"{key} bigint, embedding {kind}, cell int{more}")


@dataclass(frozen=True)
class Summary:
    """Of each cell: its number, rows, lowest and highest place on the leading axes, largest length beyond them, mean direction."""

    cell: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rest: np.ndarray
    mean: np.ndarray

    def bounds(self, y: np.ndarray) -> np.ndarray:
        """The largest cosine that a query (row) can have with a vector of a cell (column)."""
        m = self.low.shape[1]
        up, down = np.maximum(y[:, :m], 0), np.minimum(y[:, :m], 0)
        beyond = np.linalg.norm(y[:, m:], axis=1)[:, None] * self.rest[None]
        return up @ self.high.T + down @ self.low.T + beyond


def summarise(placed: DataFrame, cells: Cells) -> Summary:
    """One row a cell reaches the driver: at most CELLS of them, of some 2 * dim numbers."""
    m = min(LEADING, cells.dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            _, v = units(batch.column(0), cells.dim)
            cell = batch.column(1).to_numpy()
            y = v @ cells.axes.T
            for c in np.unique(cell):
                own = y[cell == c]
                new = [len(own), own[:, :m].min(0), own[:, :m].max(0), np.linalg.norm(own[:, m:], axis=1).max(), own.sum(0)]
                old = held.get(int(c))
                held[int(c)] = new if old is None else [old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2]), max(old[3], new[3]), old[4] + new[4]]
        rows = [{"cell": c, "n": h[0], "low": h[1].tolist(), "high": h[2].tolist(), "rest": float(h[3]), "total": h[4].tolist()} for c, h in held.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cell", pa.int32()), ("n", pa.int64()), *[(k,
            pa.list_(pa.float64())) for k in ("low", "high")], ("rest", pa.float64()), ("total", pa.list_(pa.float64()))]))

    each = placed.select("embedding", "cell").mapInArrow(run, "cell int, n bigint, low array<double>, high array<double>, rest double, total array<double>")
    at = lambda f, c, size: F.array(*[f(F.col(c)[i]) for i in range(size)]).alias(c)
    whole = each.groupBy("cell").agg(F.sum("n").alias("n"), at(F.min, "low", m), at(F.max, "high", m), F.max("rest").alias("rest"), at(F.sum, "total", cells.dim)).orderBy("cell").collect()
    col = lambda c, shape=(): np.array([r[c] for r in whole], float).reshape(len(whole), *shape)
    total = col("total", (cells.dim,))
    # bounds hold in spite of rounding
    return Summary(col("cell").astype(int), col("n").astype(int), col("low", (m,)) - 1e-9, col("high", (m,)) + 1e-9, col("rest") + 1e-9, total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-300))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, by rounded score, then id; -inf is none."""
    if score.shape[1] > k:
        # columns among the k best of some row, with all that tie
        least = np.partition(score, -k, axis=1)[:, -k]
        rows, cols = np.nonzero(score >= least[:, None] - 10.0**-DIGITS)
    else:
        rows, cols = np.nonzero(score > -np.inf)
    s = score[rows, cols]
    fine = s > -np.inf
    rows, cols, s = rows[fine], cols[fine], s[fine]
    order = np.lexsort((ids[cols], -np.round(s, DIGITS), rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows)
    top = np.arange(len(rows)) - first < k
    return rows[top], cols[top]


def _meet(pairs: DataFrame, vectors: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], block: int) -> DataFrame:
    """(q, vec_id, score) of work(queries, vectors) on each (cell, tile): pairs (q, embedding, least, cell, tile, salt) with vectors.

    Where many queries meet one tile they come a block at a time, and its vectors once for each block.
    """
    # one row for each tile that is met
    met = pairs.groupBy("cell", "tile").count().withColumn("parts", F.ceil(F.col("count") / block).cast("int")).drop("count")
    left = pairs.join(met, ["cell", "tile"]).withColumn("part", F.pmod("salt", "parts").cast("int")).select("cell", "tile", "part", "q", "embedding", "least")
    right = vectors.join(met, ["cell", "tile"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        return work(queries, rows)

    keys = ["cell", "tile", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "q bigint, vec_id bigint, score double")


def _scan(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Every query of a block with every vector of a tile, some hundred at a time."""

    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        _, u = units(queries.column("embedding"))
        _, v = units(rows.column("embedding"))
        q, ids, least = (t.column(c).to_numpy() for t, c in ((queries, "q"), (rows, "vec_id"), (queries, "least")))
        found = []
        for a in range(0, len(q), 256):
            s = u[a : a + 256] @ v.T
            s[(q[a : a + 256, None] == ids[None]) | (s < least[a : a + 256, None])] = -np.inf
            i, j = best(s, ids, k)
            found.append((q[a + i], ids[j], s[i, j]))
        return pa.table({n: np.concatenate(x) for n, x in zip(("q", "vec_id", "score"), zip(*found))})

    return work


def _tiles(summary: Summary, tile: int) -> dict[int, int]:
    return {int(c): int(-(-n // tile)) for c, n in zip(summary.cell, summary.n)}


def _with_tiles(rows: DataFrame, tiles: dict[int, int]) -> DataFrame:
    """rows and `tiles`, how many their cell has. At most CELLS rows are broadcast."""
    table = rows.sparkSession.createDataFrame(list(tiles.items()), "cell int, tiles int")
    return rows.join(F.broadcast(table), "cell")


def top_of_each(found: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, score, r): the k best of each query from its partial ones."""
    number = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", DIGITS).desc(), "vec_id"))
    return found.withColumn("r", number).where(F.col("r") <= k)


def nearest(embeddings: DataFrame, queries: DataFrame, k: int, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """(q, vec_id, score, r): exactly the k nearest by cosine of each query (q, embedding) among embeddings (vec_id, embedding).

    Ties go to the smaller vec_id; a query is not its own neighbour. Vectors that are null, zero, of another size or not
    finite are no neighbours and find none; a null q is left out; rows with one q are one query's, so give distinct ones.
    First each query meets one tile of its own cell, which gives a cosine that its k-th neighbour reaches at least; then it
    meets the tiles of those cells alone whose bound reaches that. A task holds a tile and a block of queries. What the
    driver holds: one summary a cell.
    """
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], "q bigint, vec_id bigint, score double, r int")
    rows = embeddings.count()
    space = fit(embeddings, rows, tile, most=cells)
    if space is None:
        return empty
    vectors = stash(place(embeddings, "vec_id", space).withColumn("salt", F.monotonically_increasing_id()), "vectors")
    summary = summarise(vectors, space)
    if not len(summary.cell):
        return empty
    tiles = _tiles(summary, tile)
    vectors = _with_tiles(vectors, tiles).withColumn("tile", F.pmod("salt", "tiles").cast("int")).select("cell", "tile", "vec_id", "embedding")
    known = set(tiles)
    asked = place(queries.where("q is not null"), "q", space, lambda y: {"bounds": list(summary.bounds(y))}, ", bounds array<double>")
    asked = stash(asked.withColumn("salt", F.monotonically_increasing_id()), "queries")
    # a cell may hold no vector; its queries start without a bound
    home = _with_tiles(asked.where(F.col("cell").isin(*known)), tiles).withColumn("tile", F.pmod("salt", "tiles").cast("int"))
    work = _scan(k)
    near = stash(_meet(home.select("q", "embedding", F.lit(-2.0).alias("least"), "cell", "tile", "salt"), vectors, work, tile), "near")
    reach = near.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("q", "least")
    open_ = asked.join(reach, "q", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)) - 10.0**-DIGITS)
    cell_of = F.array(*[F.lit(int(c)) for c in summary.cell])
    hit = F.filter(F.arrays_zip(cell_of.alias("c"), F.col("bounds").alias("b")), lambda x: x["b"] >= F.col("least"))
    pairs = open_.select("q", "embedding", "least", "salt", F.col("cell").alias("own"), F.explode(hit).alias("x")).withColumn("cell", F.col("x.c"))
    pairs = _with_tiles(pairs, tiles).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # the tile that it has met
    pairs = pairs.where((F.col("cell") != F.col("own")) | (F.col("tile") != F.pmod("salt", "tiles")))
    rest = _meet(pairs.select("q", "embedding", "least", "cell", "tile", "salt"), vectors, work, tile)
    return top_of_each(near.unionByName(rest), k)


@dataclass(frozen=True)
class GraphIndex:
    """A stored index: cells with their mean directions, and a table of nodes (cell, tile, node, vec_id, embedding, links)."""

    cells: Cells
    summary: Summary
    nodes: DataFrame
    shard: int


def link(v: np.ndarray, links: int, seed: int) -> list[np.ndarray]:
    """Neighbours of each node of a small-world graph over unit vectors.

    Of twice as many nearest those stay that no nearer one stays closer to, then the nearest others up to half; links
    go both ways, twice `links` at most by cosine, and a ring through all nodes keeps the graph in one piece.
    """
    n = len(v)
    v = v.astype(np.float32)
    rng = np.random.default_rng(seed)
    if n <= 1:
        return [np.zeros(0, np.int32)] * n
    m = min(2 * links, n - 1)
    own_end, other_end = [], []
    for at in range(0, n, 256):
        own = np.arange(at, min(n, at + 256))
        s = v[own] @ v.T
        s[np.arange(len(own)), own] = -np.inf
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        to_own = np.take_along_axis(s, near, 1)
        among = np.matmul(v[near], v[near].transpose(0, 2, 1))
        keep = np.zeros(near.shape, bool)
        for j in range(m):
            hidden = (keep[:, :j] & (among[:, :j, j] > to_own[:, j : j + 1])).any(axis=1)
            keep[:, j] = ~hidden & (keep.sum(1) < links)
        # nearest first among those left out
        room = np.maximum(links // 2 - keep.sum(1), 0)
        keep |= ~keep & (np.cumsum(~keep, axis=1) <= room[:, None])
        i, j = np.nonzero(keep)
        own_end.append(own[i])
        other_end.append(near[i, j])
    a, b = np.concatenate(own_end), np.concatenate(other_end)
    # a ring through all, and one to anywhere
    ring = rng.permutation(n)
    far = np.zeros((n, 2), np.int64)
    far[ring, 0], far[:, 1] = np.roll(ring, -1), rng.integers(0, n, n)
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = pairs // n, pairs % n
    near = np.concatenate([np.einsum("ed,ed->e", v[a[x : x + 65536]], v[b[x : x + 65536]]) for x in range(0, len(a), 65536)])
    order = np.lexsort((b, -near, a))
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    a, b = a[nth < 2 * links], b[nth < 2 * links]
    at = np.searchsorted(a, np.arange(n + 1))
    return [np.unique(np.concatenate((b[at[x] : at[x + 1]], far[x]))).astype(np.int32) for x in range(n)]


def walk(v: np.ndarray, links: list[np.ndarray], q: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(node, cosine) of some `ef` near ones of each query: all queries at once follow the links of their `wide` best nodes."""
    n, m = len(v), len(q)
    v, q = v.astype(np.float32), q.astype(np.float32)
    most = max((len(x) for x in links), default=0)
    table = np.full((n + 1, max(most, 1)), n, np.int64)
    for x, own in enumerate(links):
        table[x, : len(own)] = own
    ef = min(ef, n)
    start = np.unique(np.linspace(0, n - 1, min(n, max(ef, 16))).astype(np.int64))
    row = np.arange(m)[:, None]
    # one more node, met from the outset, stands for none
    met = np.zeros((m, n + 1), bool)
    met[:, n] = True
    met[:, start] = True
    ids, s = np.broadcast_to(start, (m, len(start))).copy(), q @ v[start].T
    done = np.zeros(ids.shape, bool)
    while True:
        if ids.shape[1] > ef:
            top = np.argpartition(-s, ef - 1, axis=1)[:, :ef]
            ids, s, done = (np.take_along_axis(x, top, 1) for x in (ids, s, done))
        left = np.where(done, -np.inf, s)
        some = np.argpartition(-left, min(wide, ids.shape[1]) - 1, axis=1)[:, :wide]
        some_s = np.take_along_axis(left, some, 1)
        if not np.isfinite(some_s).any():
            return ids, s
        np.put_along_axis(done, some, True, 1)
        front = np.where(np.isfinite(some_s), np.take_along_axis(ids, some, 1), n)
        to = np.sort(table[front].reshape(m, -1), axis=1)
        new = ~met[row, to]
        new[:, 1:] &= to[:, 1:] != to[:, :-1]
        met[row, to] = True
        score = np.full(to.shape, -np.inf, np.float32)
        i, j = np.nonzero(new)
        score[i, j] = np.einsum("ed,ed->e", q[i], v[to[i, j]])
        ids, s, done = np.hstack((ids, to)), np.hstack((s, score)), np.hstack((done, ~new))


def build_graph_index(embeddings: DataFrame, path: str, shard: int = SHARD, links: int = 16, cells: int = CELLS) -> GraphIndex | None:
    """Write an index of every vector with a direction: a graph for each shard, some `shard` vectors of one cell; and read it.

    Shards are built where their rows are, one group a shard; a cell of more vectors than a shard holds has several. None: no vector.
    """
    space = fit(embeddings, embeddings.count(), shard, most=cells)
    if space is None:
        return None
    vectors = stash(place(embeddings, "vec_id", space).withColumn("salt", F.monotonically_increasing_id()), "vectors")
    summary = summarise(vectors, space)
    dealt = _with_tiles(vectors, _tiles(summary, shard)).withColumn("tile", F.pmod("salt", "tiles").cast("int")).select("cell", "tile", "vec_id", "embedding")
    kind = to_arrow_type(dealt.schema["embedding"].dataType)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        _, v = units(rows.column("embedding"))
        edges = link(v, links, key[0].as_py() * 1_000_003 + key[1].as_py())
        return pa.table({"cell": rows.column("cell"), "tile": rows.column("tile"), "node": pa.array(np.arange(len(v)), pa.int32()),
            "vec_id": rows.column("vec_id"), "embedding": rows.column("embedding").cast(kind),
            "links": pa.array([x.tolist() for x in edges], pa.list_(pa.int32()))})

    schema = f"cell int, tile int, node int, vec_id bigint, embedding {vectors.schema['embedding'].dataType.simpleString()}, links array<int>"
    dealt.groupBy("cell", "tile").applyInArrow(build, schema).write.parquet(f"{path}/nodes")
    spark = embeddings.sparkSession
    fitted = [(space.axes.ravel().tolist(), space.centres.ravel().tolist(), space.dim, shard)]
    spark.createDataFrame(fitted, "axes array<double>, centres array<double>, dim int, shard int").write.parquet(f"{path}/space")
    held = [(int(c), int(n), *[x[i].tolist() for x in (summary.low, summary.high)], float(summary.rest[i]), summary.mean[i].tolist()) for i, (c, n) in enumerate(zip(summary.cell, summary.n))]
    spark.createDataFrame(held, "cell int, n bigint, low array<double>, high array<double>, rest double, mean array<double>").write.parquet(f"{path}/cells")
    return read_graph_index(spark, path)


def read_graph_index(spark: SparkSession, path: str) -> GraphIndex:
    """The axes and centres and one row for each cell reach the driver."""
    t = spark.read.parquet(f"{path}/space").first()
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    col = lambda c: np.array([r[c] for r in rows])
    space = Cells(np.array(t.axes).reshape(-1, t.dim), np.array(t.centres).reshape(-1, t.dim))
    return GraphIndex(space, Summary(*[col(c) for c in ("cell", "n", "low", "high", "rest", "mean")]), spark.read.parquet(f"{path}/nodes"), t.shard)


def graph_nearest(index: GraphIndex, queries: DataFrame, k: int, probes: int | None = None, ef: int = 96) -> DataFrame:
    """(q, vec_id, score, r): as nearest, approximately: each query walks every shard's graph, and the answers are merged.

    Within a shard the `ef` best nodes met are kept; with `ef` as large as a shard the answer is exact. probes: only the shards
    of so many cells, by nearest mean direction, which is for vectors that do lie in clusters.
    """
    mean, cell = index.summary.mean, index.summary.cell
    n = min(probes or len(cell), len(cell))

    def route(y: np.ndarray) -> dict[str, list]:
        return {"to": list(cell[np.argsort(-(y @ mean.T), axis=1, kind="stable")[:, :n]].astype(np.int32))}

    asked = place(queries.where("q is not null"), "q", index.cells, route, ", to array<int>").withColumn("salt", F.monotonically_increasing_id())
    tiles = _tiles(index.summary, index.shard)
    pairs = _with_tiles(asked.drop("cell").withColumn("cell", F.explode("to")), tiles).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        _, u = units(asked.column("embedding"))
        _, v = units(rows.column("embedding"))
        q, ids = asked.column("q").to_numpy(), rows.column("vec_id").to_numpy()
        links = [np.array(x, np.int64) for x in rows.column("links").to_pylist()]
        found = []
        for a in range(0, len(q), 256):
            node, s = walk(v, links, u[a : a + 256], max(ef, k + 1))
            node = np.minimum(node, len(v) - 1)
            own = ids[node]
            # cosines in double precision
            exact = np.einsum("qd,qed->qe", u[a : a + 256], v[node])
            exact[~np.isfinite(s) | (own == q[a : a + 256, None])] = -np.inf
            order = np.lexsort((own, -np.round(exact, DIGITS)), axis=1)[:, :k]
            i = np.repeat(np.arange(len(order)), order.shape[1])
            j = order.ravel()
            fine = exact[i, j] > -np.inf
            found.append((q[a + i[fine]], own[i[fine], j[fine]], exact[i[fine], j[fine]]))
        return pa.table({n: np.concatenate(x) for n, x in zip(("q", "vec_id", "score"), zip(*found))})

    pairs = pairs.select("q", "embedding", F.lit(-2.0).alias("least"), "cell", "tile", "salt")
    return top_of_each(_meet(pairs, index.nodes, work, TILE), k)
