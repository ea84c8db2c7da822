"""Operator 8: near-duplicate vectors by PCA-ordered tiled comparison."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import components, partitions, stash

#: Vectors that are multiplied at once, and those of a block, of which a task holds two: fewer where they are long.
TILE, BLOCK, BLOCK_NUMBERS = 512, 8192, 1 << 20
#: Leading dimensions that are compared first, the next ones at a time, and those by which large labels are cut into cells.
LEAD, STEP, GRID = 8, 16, 3
#: Parts of a dense cell, at most, and a number over the blocks of one.
SLABS, SUBS = 64, 1 << 32
_SLACK = 1e-9


def unit(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision; the largest component is made 1 first, so that none overflows."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """(dim, dim) orthogonal axes of the vectors `e`, the widest first: from second moments of all rows' directions.

    Each task sends a dim x dim matrix as rows, and these are added up by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((dim, dim))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                u = unit(b.column(0).slice(at, BLOCK), dim)
                s += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(s))], names=["i", "m"])

    rows = vectors.select("e").mapInArrow(run, "i int, m array<double>")
    rows = rows.select("i", F.posexplode("m").alias("j", "v")).where("j >= i").groupBy("i", "j").agg(F.sum("v").alias("v"))
    # dim^2 / 2 numbers, whatever the number of vectors
    s = np.zeros((dim, dim))
    for i, j, v in rows.collect():
        s[i, j] = s[j, i] = v
    return np.linalg.eigh(s)[1][:, ::-1]


def compare(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with a[i].b[j] >= threshold, for unit vectors a, b and the same along orthogonal axes, widest first.

    The leading dimensions are multiplied first; the rest adds at most the product of the suffix norms (Cauchy-Schwarz),
    so pairs that cannot reach the threshold go no further. Those that are left are decided by a and b themselves.
    """
    dim, low, at = a.shape[1], threshold - _SLACK, LEAD
    rest = lambda at: (np.linalg.norm(x[:, at:], axis=1) for x in (pa_, pb))
    whole, few = pa_[:, :at] @ pb[:, :at].T, None
    i, j = np.nonzero(whole + np.outer(*rest(at)) >= low)
    while len(i) and at < dim:
        to = min(at + STEP, dim)
        # many pairs left: the whole tile is multiplied; few: they alone
        if few is None and 16 * len(i) > whole.size:
            whole += pa_[:, at:to] @ pb[:, at:to].T
            got = whole[i, j]
        else:
            got = few = (whole[i, j] if few is None else few) + np.einsum("ij,ij->i", pa_[i, at:to], pb[j, at:to])
        at = to
        na, nb = rest(at)
        on = got + na[i] * nb[j] >= low
        i, j, few = i[on], j[on], None if few is None else few[on]
    if len(i):
        exact = (a @ b.T)[i, j] if 16 * len(i) > whole.size else np.einsum("ij,ij->i", a[i], b[j])
        on = exact >= threshold
        i, j = i[on], j[on]
    return i, j


class Block:
    """Unit vectors of a task: those along the axes are in order of the first, so that tiles of them lie close together."""

    def __init__(self, u: np.ndarray, axes: np.ndarray | None) -> None:
        p = u if axes is None else u @ axes
        self.order = np.argsort(p[:, 0], kind="stable")
        self.u, self.p = u[self.order], p[self.order]
        cuts = np.arange(0, len(u), TILE)
        lead = self.p[:, :LEAD]
        self.tiles = [slice(c, min(c + TILE, len(u))) for c in cuts.tolist()]
        self.low, self.high = np.minimum.reduceat(lead, cuts), np.maximum.reduceat(lead, cuts)

    def pairs(self, other: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of linked rows as they were given; of a block with itself, each pair once. Tiles further apart than linked
        vectors can be are not multiplied.
        """
        gap = np.maximum(0.0, np.maximum(self.low[:, None] - other.high[None], other.low[None] - self.high[:, None]))
        near = (gap**2).sum(axis=2) <= 2 - 2 * threshold + _SLACK
        for x, y in zip(*np.nonzero(np.triu(near) if self is other else near)):
            s, t = self.tiles[x], other.tiles[y]
            i, j = compare(self.u[s], other.u[t], self.p[s], other.p[t], threshold)
            if self is other and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield self.order[i + s.start], other.order[j + t.start]


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (the smallest number of each tree, for every row) after rows i and j are joined."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _block_pairs(dense: DataFrame, cell: list[str], axes: np.ndarray, r: float) -> DataFrame:
    """Rows of cells of more than two blocks, each once for each pair (i, j) of its own block with one that may hold linked vectors.

    A cell is cut by rank along that of its leading axes on which it is widest, into SLABS parts at most; a part of more than a
    block's rows is several blocks. Two parts are near if the boxes of their vectors, along the leading axes and by the norm of
    the rest, are no further apart than r; others never meet, so a vector is sent to the blocks of near parts alone. What is
    compared for that is a row a part, SLABS^2 pairs a cell at most.
    """
    dim, lead = len(axes), [f"l{a}" for a in range(LEAD + 1)]
    kind = {f.name: f.dataType.simpleString() for f in dense.schema.fields}

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            for n in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == n))
                u = unit(part.column("e"), n)
                p = u @ axes if n == dim else u
                x = np.zeros((len(p), LEAD + 1))
                x[:, : min(LEAD, n)] = p[:, :LEAD]
                x[:, LEAD] = np.linalg.norm(p[:, LEAD:], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, x.T.copy())], names=[*part.schema.names, *lead])

    rows = stash(dense.mapInArrow(turned, ", ".join([f"{c} {k}" for c, k in kind.items()] + [f"{x} double" for x in lead])), "dense")
    std = F.array(*[F.stddev_pop(x) for x in lead[:LEAD]])
    widest = rows.groupBy(*cell).agg(std.alias("s")).select(*cell, (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("axis"))
    along = rows.join(widest, cell).withColumn("x", F.get(F.array(*lead[:LEAD]), F.col("axis")))
    ranks = [(k + 1) / SLABS for k in range(SLABS - 1)]
    cuts = along.groupBy(*cell).agg(F.percentile_approx("x", ranks, 10_000).alias("cuts"), F.first("axis").alias("axis"))
    # as many parts as blocks, or SLABS
    own = rows.join(cuts, cell).withColumn("x", F.get(F.array(*lead[:LEAD]), F.col("axis")))
    parts = F.least(F.col("blocks"), F.lit(SLABS))
    slab = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("x"))) * parts / SLABS).cast("long")
    own = stash(own.withColumn("slab", slab).drop("cuts", "axis", "x"), "slabs")
    sizes = own.groupBy(*cell, "slab").agg(F.ceil(F.count("*") / F.max("most")).cast("long").alias("subs"), *[f(x).alias(f"{k}{x}") for x in lead for k, f in (("a", F.min), ("b", F.max))])
    sizes = stash(sizes, "parts")
    other = sizes.withColumnsRenamed({c: f"o_{c}" for c in sizes.columns})
    gap = lambda x: F.greatest(F.lit(0.0), F.col(f"a{x}") - F.col(f"o_b{x}"), F.col(f"o_a{x}") - F.col(f"b{x}"))
    far = sum((gap(x) * gap(x) for x in lead[1:]), gap(lead[0]) * gap(lead[0]))
    here = functools.reduce(lambda p, q: p & q, [F.col(c) == F.col(f"o_{c}") for c in cell])
    near = sizes.join(other, here).where(far <= r * r + _SLACK)
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_subs") - 1), lambda k: F.col("o_slab") * SUBS + k)
    near = near.groupBy(*cell, "slab").agg(F.first("subs").alias("subs"), F.flatten(F.collect_list(blocks)).alias("met"))
    sent = own.join(near, [*cell, "slab"]).withColumn("own", F.col("slab") * SUBS + F.pmod(F.xxhash64("node"), F.col("subs"))).withColumn("other", F.explode("met"))
    return sent.select(*cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "guest", "node", "copies", "e")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tile: int = BLOCK) -> DataFrame:
    """vec_id, label, n_links, component_id, kept of every row; vectors link within a label at cosine >= threshold.

    Vectors that are null, empty, zero or hold a null or a non-finite component, or without a label, link with nothing;
    others link with those of their own size. Equal vectors (by 128 bits of hashes) are compared once, as one of that many copies.
    Vectors of one label and size that fill no more than a block meet in one task. More are cut into cells along the first
    principal axes (their own first components, for sizes other than the most frequent), at least twice as wide as linked
    vectors can be apart, r = sqrt(2 - 2 threshold): each vector has a home, and is a guest in the cells before it whose
    border lies within r. A cell of more than two blocks is cut along its widest axis and dealt out as pairs of blocks that a
    bound doesn't keep apart (_block_pairs). A pair gives a row for each vector that links, not for each link.
    Null vec_id: links, but is no other's component_id. Repeated ids are vectors of their own. No rows: none.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast(kind).alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "label", "e", good.alias("good"), F.size("e").alias("n"), F.xxhash64("e").alias("h1"), F.xxhash64(F.lit("second"), "e").alias("h2"))
    same = ["label", "n", "h1", "h2"]
    distinct = rows.where("good").groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("e").alias("e"))
    distinct = stash(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    usual = distinct.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if not usual:
        return rows.select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = int(usual[0])
    axes, r = principal_axes(distinct.where(F.col("n") == dim), dim), float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    label = distinct.schema["label"].dataType.simpleString()

    def by_size(batch: pa.RecordBatch):
        """(rows, first coordinates) for each size of a batch."""
        sizes = batch.column("n").to_numpy()
        for n in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == n))
            u = unit(part.column("e"), n)
            p = np.zeros((len(u), GRID))
            q = u @ axes[:, :GRID] if n == dim else u[:, :GRID]
            p[:, : q.shape[1]] = q
            yield part, p

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, p in by_size(batch):
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("n"), *map(pa.array, p.T.copy())], names=["label", "n", *(f"p{a}" for a in range(GRID))])

    # of a block of `tile` vectors, or fewer
    most = F.greatest(F.least(F.lit(TILE), F.lit(tile)), F.least(F.lit(tile), F.floor(F.lit(BLOCK_NUMBERS) / F.col("n")))).cast("int")
    many = distinct.groupBy("label", "n").count().where(F.col("count") > 2 * most)
    # only labels of more than two blocks are here, so there are fewer than rows by a block
    wide = many.select("label", "n")
    spread = distinct.join(wide, ["label", "n"], "left_semi").select("label", "n", "e").mapInArrow(lead, f"label {label}, n int, " + ", ".join(f"p{a} double" for a in range(GRID)))
    cells = F.ceil(F.pow(F.count("*") / most, F.lit(1.0 / GRID)))
    spread = stash(spread.groupBy("label", "n").agg(*[F.greatest(F.lit(2 * r), 4 * F.stddev_pop(f"p{a}") / cells).alias(f"w{a}") for a in range(GRID)]), "widths")
    earlier = [by for by in itertools.product((-1, 0, 1), repeat=GRID) if by < (0,) * GRID]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its home cell, and as a guest in those before it that it may have links in."""
        for batch in batches:
            for part, p in by_size(batch):
                w = np.stack([part.column(f"w{a}").to_numpy(zero_copy_only=False) for a in range(GRID)], axis=1).astype(float)
                cut = ~np.isnan(w)
                w = np.where(cut, w, 1.0)
                home = np.where(cut, np.floor(p / w), 0).astype(np.int64)
                below, above = p - home * w, (home + 1) * w - p
                reach = {-1: cut & (below <= r), 0: np.ones_like(cut), 1: cut & (above <= r)}
                rows, to, guest = [np.arange(len(p))], [home], [np.zeros(len(p), bool)]
                for by in earlier:
                    on = np.flatnonzero(np.logical_and.reduce([reach[x][:, a] for a, x in enumerate(by)]))
                    rows.append(on)
                    to.append(home[on] + by)
                    guest.append(np.ones(len(on), bool))
                at, to = np.concatenate(rows), np.concatenate(to)
                held = part.select(["label", "n", "node", "copies", "e"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*held.columns, *map(pa.array, to.T.copy()), pa.array(np.concatenate(guest))], names=[*held.schema.names, *cell, "guest"])

    cell = [f"c{a}" for a in range(GRID)]
    held = f"label {label}, n int, node long, copies long, e {kind}, " + ", ".join(f"{c} long" for c in cell) + ", guest boolean"
    sent = distinct.select("label", "n", "node", "copies", "e").join(spread, ["label", "n"], "left")
    placed = sent.mapInArrow(place, held)
    counts = placed.groupBy("label", "n", *cell).agg(F.count_if(~F.col("guest")).alias("homes"), F.count("*").alias("all"))
    # a cell without homes has no link of its own
    counts = stash(counts.where("homes > 0").select("label", "n", *cell, F.when(F.col("all") <= 2 * most, 0).otherwise(F.ceil(F.col("all") / most)).cast("long").alias("blocks"), most.alias("most")), "cells")
    one = placed.join(counts.where("blocks = 0"), ["label", "n", *cell])
    one = one.select("label", "n", *cell, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("own"), "guest", "node", "copies", "e")
    dense = placed.join(counts.where("blocks > 0"), ["label", "n", *cell])
    dealt = one.unionByName(_block_pairs(dense, ["label", "n", *cell], axes, r))
    task = ["label", "n", *cell, "i", "j"]

    def meet(t: pa.Table) -> pa.Table:
        """Link counts of a task's vectors and a forest over their links; guests meet in their own homes."""
        n, i, j = (t.column(c)[0].as_py() for c in ("n", "i", "j"))
        node, copies, own, guest = (t.column(c).to_numpy() for c in ("node", "copies", "own", "guest"))
        u = unit(t.column("e").combine_chunks(), n)
        count, root = np.zeros(len(node), np.int64), np.arange(len(node))
        turn = axes if n == dim else None
        part = {(k, g): np.flatnonzero((own == k) & (guest == g)) for k in {i, j} for g in (False, True)}
        block = {k: Block(u[rows], turn) if len(rows) else None for k, rows in part.items()}
        pairs = [((i, False), (i, False)), ((i, False), (i, True))] if i == j else [((i, False), (j, False)), ((i, False), (j, True)), ((i, True), (j, False))]
        for x, y in pairs:
            if block[x] is None or block[y] is None:
                continue
            for s, z in block[x].pairs(block[y], threshold):
                s, z = part[x][s], part[y][z]
                np.add.at(count, s, copies[z])
                np.add.at(count, z, copies[s])
                root = join_roots(root, s, z)
        at = np.flatnonzero(count > 0)
        return pa.table({"node": node[at], "links": count[at], "root": node[root[at]]})

    found = dealt.repartition(partitions(spark), *task).groupBy(*task).applyInArrow(meet, "node long, links long, root long")
    found = stash(found, "tiles")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = distinct.select("node", *same, "least", "copies").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = stash(nodes, "nodes")
    smallest = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(smallest, "component").select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = rows.drop("e")
    linked = rows.where("good").join(nodes, same).select("vec_id", "label", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; see near_vectors for nulls, ties, repeated ids and empty tables."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


#: op8_embedding_dedup by DuckDB. All pairs of a label, so for small tables.
OP8_SQL = """WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id v, vec_id c FROM embeddings UNION SELECT b, c FROM reach JOIN links ON v = a),
least AS (SELECT v, min(c) c FROM reach GROUP BY v), n AS (SELECT a, count(*) n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN least ON v = vec_id LEFT JOIN n ON a = vec_id"""
