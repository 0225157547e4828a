"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors at cosine c lie sqrt(2 - 2c) = epsilon apart. Vectors are rotated to principal axes
(fitted on a bounded sample; that steers speed only), ordered by their grid cells of side epsilon on
the leading axes, and cut into blocks that are intervals of that order. Blocks whose boxes lie within
epsilon of each other are a pair; pairs are dealt in tiles of a few blocks a side, so a block travels
once for each tile, not for each pair. A task joins a pair by recursion, halving intervals and
skipping halves whose boxes are further apart, down to small products of matrices.

Pairs are never rows: a joined pair of blocks gives, for each vector with links, their number and a
root of its links' forest. Equal vectors are one class throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import batch, components, table

COSINE = 0.95
#: Vectors that the principal axes are fitted on, at most (about).
SAMPLE = 20_000
#: Leading axes of the grid; axes of the boxes (more of them skip more).
AXES, BOX_AXES = 4, 16
LEAF = 512
#: Blocks on a side of a tile, and axes whose cells two blocks must share to be compared at all.
TILE, PAIR_AXES = 4, 2
SLACK = 1e-6


def _is_fine(dim: int | None = None):
    """True where a vector can link: no null, zero or non-finite part, and a vec_id."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
    return F.coalesce(fine if dim is None else fine & (F.size(v) == dim), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that no square overflows
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _axes(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    def fit(batches):
        total, outer, count = np.zeros(dim), np.zeros((dim, dim)), 0
        for b in batches:
            if b.num_rows:
                m = _unit(_matrix(b.column(0)))
                total, outer, count = total + m.sum(axis=0), outer + m.T @ m, count + len(m)
        if count:
            mean = total / count
            yield pa.record_batch([pa.array([np.linalg.eigh(outer / count - np.outer(mean, mean))[1][:, ::-1].tobytes()])], names=["axes"])

    every = max(1, n // SAMPLE)
    r = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("v").coalesce(1).mapInArrow(fit, "axes binary").first()
    return np.frombuffer(r.axes).reshape(dim, dim) if r else np.eye(dim)


def _ordered(rows: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """Adds the grid cells on the leading axes, as one array that sorts in grid order."""
    own = rows.sparkSession.sparkContext.broadcast(axes[:, :AXES])
    schema = pa.schema([("vec_id", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                cells = np.floor(_unit(_matrix(b.column(2))) @ own.value / epsilon).astype(np.int32)
                yield pa.record_batch([*b.columns, pa.array(list(cells), pa.list_(pa.int32()))], schema=schema)

    return rows.select("vec_id", "copies", "v").mapInArrow(run, "vec_id long, copies long, v array<double>, cells array<int>")


BLOCK = "block long, n long, ids binary, copies binary, vectors binary, low array<double>, high array<double>"
_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def _blocks(size: int, axes):
    def run(batches):
        part, k, held = TaskContext.get().partitionId(), 0, []

        def close(ids, copies, v):
            at = _unit(v) @ axes.value[:, :BOX_AXES]
            return batch(_BLOCK, [part << 32 | k], [len(ids)], [ids.tobytes()], [copies.tobytes()], [v.astype(np.float64).tobytes()], [at.min(axis=0)], [at.max(axis=0)])

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            while len(held[0]) >= size:
                yield close(*(x[:size] for x in held))
                held, k = [x[size:] for x in held], k + 1
        if held and len(held[0]):
            yield close(*held)

    return run


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class _Side:
    """A block in its task: unit vectors in double and single precision, places on the axes."""

    def __init__(self, ids: bytes, copies: bytes, vectors: bytes, axes: np.ndarray):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.v = _unit(np.frombuffer(vectors).reshape(len(self.ids), -1))
        self.single, self.at = self.v.astype(np.float32), self.v @ axes[:, :BOX_AXES]
        self.links, self.boxes = np.zeros(len(self.ids), np.int64), {}

    def box(self, i: int, j: int):
        if (i, j) not in self.boxes:
            self.boxes[i, j] = self.at[i:j].min(axis=0), self.at[i:j].max(axis=0)
        return self.boxes[i, j]


def _apart(a, b, epsilon: float) -> bool:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) > (epsilon + SLACK) ** 2


def _leaf(a: _Side, b: _Side, i0: int, i1: int, j0: int, j1: int, cosine: float, forest: _Forest) -> None:
    near = a.single[i0:i1] @ b.single[j0:j1].T >= np.float32(cosine - 1e-4)
    own = a is b and i0 == j0
    if own:
        near &= np.tri(i1 - i0, dtype=bool).T
        np.fill_diagonal(near, False)
    if not near.any():
        return
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(rows, cols)] & (a.v[i0 + rows] @ b.v[j0 + cols].T >= cosine)
    rows, cols = rows + i0, cols + j0
    np.add.at(a.links, rows, near @ b.copies[cols])
    np.add.at(b.links, cols, near.T @ a.copies[rows])
    # the leaf's own components, by passing the smallest label to and fro
    left, right, none = np.arange(len(rows)), np.full(len(cols), len(rows)), len(rows)
    while True:
        new = np.minimum(right, np.where(near, left[:, None], none).min(axis=0))
        now = np.minimum(left, np.where(near, new[None, :], none).min(axis=1))
        if (new == right).all() and (now == left).all():
            break
        left, right = now, new
    for k in np.flatnonzero(near.any(axis=1)):
        forest.link(int(a.ids[rows[k]]), int(a.ids[rows[left[k]]]))
    for k in np.flatnonzero(right < none):
        forest.link(int(b.ids[cols[k]]), int(a.ids[rows[right[k]]]))


def _join(a: _Side, b: _Side, i0: int, i1: int, j0: int, j1: int, cosine: float, epsilon: float, forest: _Forest) -> None:
    """Joins the intervals [i0, i1) of a and [j0, j1) of b; within one block, each pair once."""
    if i0 >= i1 or j0 >= j1 or _apart(a.box(i0, i1), b.box(j0, j1), epsilon):
        return
    if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
        return _leaf(a, b, i0, i1, j0, j1, cosine, forest)
    if a is b and (i0, i1) == (j0, j1):
        m = (i0 + i1) // 2
        for p in ((i0, m, i0, m), (i0, m, m, i1), (m, i1, m, i1)):
            _join(a, b, *p, cosine, epsilon, forest)
    elif i1 - i0 >= j1 - j0:
        for p in ((i0, (i0 + i1) // 2), ((i0 + i1) // 2, i1)):
            _join(a, b, *p, j0, j1, cosine, epsilon, forest)
    else:
        for p in ((j0, (j0 + j1) // 2), ((j0 + j1) // 2, j1)):
            _join(a, b, i0, i1, *p, cosine, epsilon, forest)


def _join_tiles(cosine: float, epsilon: float, axes):
    """Rows (tile, pairs, block, ids, copies, vectors), sorted by tile: a tile's blocks are held, and its
    pairs of blocks joined."""
    schema = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def joined(held: dict, pairs: list):
        for p in pairs:
            one, two = held[p["a"]], held[p["b"]]
            forest = _Forest()
            for side in (one, two):
                side.links = np.zeros(len(side.ids), np.int64)
            _join(one, two, 0, len(one.ids), 0, len(two.ids), cosine, epsilon, forest)
            for side in (one,) if one is two else (one, two):
                hit = np.flatnonzero(side.links)
                if len(hit):
                    yield batch(schema, side.ids[hit], side.links[hit], [forest.root(int(x)) for x in side.ids[hit]])

    def run(batches):
        at, held, pairs = None, {}, []
        for b in batches:
            for row in range(b.num_rows):
                tile = b.column(0)[row].as_py()
                if tile != at:
                    yield from joined(held, pairs)
                    at, held, pairs = tile, {}, b.column(1)[row].as_py()
                held[b.column(2)[row].as_py()] = _Side(*(b.column(k)[row].as_py() for k in (3, 4, 5)), axes.value)
        yield from joined(held, pairs)

    return run


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks whose boxes may be within epsilon: they share a cell of the leading axes, one of
    them widened by a cell to either side."""
    cell = lambda c, k: F.floor(F.element_at(c, k) / epsilon)
    names = [f"cell{k}" for k in range(1, PAIR_AXES + 1)]

    def spread(rows, wide):
        for k, name in enumerate(names, 1):
            rows = rows.withColumn(name, F.explode(F.sequence(cell("low", k) - wide, cell("high", k) + wide)))
        return rows

    boxes = blocks.select("block", "low", "high")
    a = spread(boxes, 1).select(F.col("block").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), *names)
    b = spread(boxes, 0).select(F.col("block").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), *names)
    gaps = F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return a.join(b, names).where((F.col("a") <= F.col("b")) & (apart <= (epsilon + SLACK) ** 2)).select("a", "b").distinct()


def _tiles(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(tile, pairs, block, ids, copies, vectors): each block once for each tile that has a pair of it."""
    number = F.row_number().over(Window.orderBy("block")) - 1  # of blocks, thousands of vectors each
    side = table(blocks.select("block", F.floor(number / TILE).alias("side")))
    own = pairs.join(side.select(F.col("block").alias("a"), F.col("side").alias("i")), "a").join(side.select(F.col("block").alias("b"), F.col("side").alias("j")), "b")
    own = own.withColumn("tile", F.struct(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")))
    tiles = table(own.groupBy("tile").agg(F.collect_list(F.struct("a", "b")).alias("pairs")).withColumn("tile", F.monotonically_increasing_id()))
    met = tiles.select("tile", "pairs", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"]))))).alias("block"))
    return met.join(blocks.select("block", "ids", "copies", "vectors"), "block").select("tile", "pairs", "block", "ids", "copies", "vectors")


def _near(fine: DataFrame, dim: int, cosine: float) -> DataFrame:
    """vec_id, n_links, component_id: a row for each row of fine (vec_id, v), all of length dim."""
    epsilon = float(np.sqrt(2 - 2 * cosine))
    members = table(fine.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = members.count()
    axes = _axes(members.select(F.col("rep").alias("vec_id"), "v"), n, dim)
    own = fine.sparkSession.sparkContext.broadcast(axes)
    size = min(4096, max(512, n // 24))
    placed = _ordered(members.select(F.col("rep").alias("vec_id"), "copies", "v"), axes, epsilon)
    parts = max(1, -(-n // (2 * size)))
    ordered = placed.repartitionByRange(parts, "cells", "vec_id").sortWithinPartitions("cells", "vec_id")
    blocks = table(ordered.select("vec_id", "copies", "v").mapInArrow(_blocks(size, own), BLOCK))
    pairs = table(_block_pairs(blocks, epsilon))
    tiles = _tiles(pairs, blocks)
    dealt = tiles.repartition("tile").sortWithinPartitions("tile")
    found = table(dealt.mapInArrow(_join_tiles(cosine, epsilon, own), "vec_id long, links long, root long"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    classes = members.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    classes = table(classes.select("v", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    return fine.join(classes, "v").select("vec_id", "n_links", "component_id")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors (vec_id, embedding).

    Links: cosine, in double precision, of `cosine` or more, between vectors of one length; each length
    is a join of its own. Vectors that are null, zero or hold null or non-finite parts, or of null
    vec_id, link with nothing. Rows that repeat a vec_id count as vectors of their own that link if
    they are near, and those of one length share one row's component. Other columns are not read; an
    empty table gives no rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = rows.where(_is_fine()).groupBy(F.size("embedding").alias("dim")).count().where("count > 1").orderBy("dim").collect()
    dims = [r["dim"] for r in lengths]
    linked = _is_fine() & F.size("embedding").isin(dims) if dims else F.lit(False)
    alone = rows.where(~F.coalesce(linked, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for dim in dims:
        alone = alone.unionByName(_near(rows.where(_is_fine(dim)).select("vec_id", F.col("embedding").alias("v")), dim, cosine))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = f"""
WITH RECURSIVE ev AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ef AS (
    SELECT vec_id, len(e) AS dim, e FROM ev
    WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
eu AS (SELECT vec_id, dim, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM ef),
el AS (SELECT a.vec_id AS a, b.vec_id AS b FROM eu a JOIN eu b ON a.dim = b.dim AND a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM el UNION SELECT reach.a, el.b FROM reach JOIN el ON el.a = reach.b),
em AS (SELECT a, min(b) AS least FROM reach GROUP BY a), en AS (SELECT a, count(*) AS n FROM el GROUP BY a)
SELECT ev.vec_id, coalesce(en.n, 0) AS n_links, least(ev.vec_id, coalesce(em.least, ev.vec_id)) AS component_id, ev.vec_id = least(ev.vec_id, coalesce(em.least, ev.vec_id)) AS kept
FROM ev LEFT JOIN en ON en.a = ev.vec_id LEFT JOIN em ON em.a = ev.vec_id
"""
