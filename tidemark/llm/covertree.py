"""Exact top-k inner products by dual-tree search over cover trees.

The upper levels of the data's tree are centres, which are rows themselves: the vectors with the smallest
hashes, at most ``pivots`` over all rows, and below each whose cell (the rows nearest to it) is more than a block at most
``pivots`` more out of that cell, with cells of their own. Each cell of each level has its greatest distance as covering radius. Small
cells share blocks. A lower cell that is still more than a block, such as the copies of one vector, is cut by a hash of its rows, so
no cell fills one task. Of rows that are equal in vec_id and vector a task keeps k: more cannot be in a result.

A query's scores with the centres of the first level and with those of its best cell give a first k-th score. Only
cells whose bound reaches it are looked at, then only the cells below them whose bound does, and only their blocks see the query, which starts there with that score. In each
pair of a block and a group of queries, both sides are indexed by cover trees; the search descends node pairs
best bound first and prunes a pair as soon as

    <cq, cr> + |cq| * rr + rq * |cr| + rq * rr

(centres c, covering radii r) is below the worst k-th score in the query node. Ties are never
pruned. The k best of each block meet in a last ranking. Scores are exact integers.

A block is sent to a group of queries only if one of the group asked for it. All tasks get the centres: at most ``pivots`` and
``CENTRE_BYTES`` together.

Vectors that are null, or hold null or non-finite components, and rows without vec_id take no
part. A query meets vectors of its own length only. Query rows that share a vec_id are one query, the least
of their vectors, and all rows of that vec_id are its own; other repeated rows are candidates each.
Scores must fit 64 bits. Empty tables give an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import table, written

K = 5
PIVOTS = 256
BLOCK_ROWS = (512, 8192)
QUERY_ROWS = 4096
LEAF = 24
CENTRE_BYTES = 64 << 20


class Node:
    """A centre, its covering radius, the rows below it, and its children (none: a leaf)."""

    __slots__ = ("centre", "children", "norm", "radius", "rows")

    def __init__(self, points: np.ndarray, rows: np.ndarray, scale: float | None = None):
        self.rows, self.centre = rows, points[rows[0]]
        self.norm = float(np.sqrt(self.centre @ self.centre))
        away = np.sqrt(((points[rows] - self.centre) ** 2).sum(axis=1))
        self.radius = float(away.max())
        self.children: list[Node] = []
        if len(rows) <= LEAF or self.radius == 0:
            return
        # children: centres more than half the scale apart that cover all rows within it
        scale = 2.0 ** math.ceil(math.log2(self.radius)) / 2 if scale is None else scale / 2
        while scale >= self.radius:
            scale /= 2
        left, groups = rows, []
        while len(left):
            near = np.sqrt(((points[left] - points[left[0]]) ** 2).sum(axis=1)) <= scale
            groups.append(left[near])
            left = left[~near]
        # where rows lie too far apart for the level, its small groups stay together as leaves of their own
        alone = [g for g in groups if len(g) <= LEAF // 4]
        groups = [g for g in groups if len(g) > LEAF // 4]
        if alone:
            flat = np.concatenate(alone)
            groups += [flat[i : i + LEAF] for i in range(0, len(flat), LEAF)]
        self.children = [Node(points, g, scale) for g in groups]


def _bound(q: Node, r: Node) -> float:
    most = float(q.centre @ r.centre) + q.norm * r.radius + q.radius * r.norm + q.radius * r.radius
    return most + 1e-9 * (abs(most) + q.norm * r.norm) + 1e-6


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int = K, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best data rows of each query, by score descending, then vec_id.

    Rows below a query's ``least``, where given, are not looked for.
    """
    size = max(int(np.abs(queries).max(initial=0)), int(np.abs(data).max(initial=0)))
    exact = np.float64 if size * size * max(1, data.shape[1]) < 1 << 53 else np.int64
    q_exact, d_exact = queries.astype(exact), data.astype(exact)
    q_points, d_points = queries.astype(np.float64), data.astype(np.float64)
    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, vec_id), sorted
    kth = np.full(len(queries), -np.inf) if least is None else least.copy()

    def meet(q: Node, r: Node) -> None:
        score = q_exact[q.rows] @ d_exact[r.rows].T
        for at, row in zip(q.rows.tolist(), score, strict=True):
            hit = np.flatnonzero(row >= kth[at])
            if len(hit):
                own = query_ids[at]
                new = [(-int(row[h]), int(data_ids[r.rows[h]])) for h in hit if data_ids[r.rows[h]] != own]
                best[at] = sorted(best[at] + new)[:k]
                if len(best[at]) == k:
                    kth[at] = -best[at][-1][0]

    stack = [(q := Node(q_points, np.arange(len(queries))), r := Node(d_points, np.arange(len(data))), _bound(q, r))]
    while stack:
        q, r, most = stack.pop()
        if most < kth[q.rows].min():
            continue
        if not q.children and not r.children:
            meet(q, r)
            continue
        if r.children and (not q.children or r.radius >= q.radius):
            pairs = [(q, c, _bound(q, c)) for c in r.children]
        else:
            pairs = [(c, r, _bound(c, r)) for c in q.children]
        stack += sorted(pairs, key=lambda x: x[2])  # the best bound is taken next
    rows = [(i, v, -s) for i, found in enumerate(best) for s, v in found]
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(256 * x) of every component, of rows that take part."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * 256.0))
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def _thinned(batches, k: int):
    """The same batches of (vec_id, v) without what is equal to ``k`` or more earlier rows of one batch."""
    full: dict[int, set[bytes]] = {}
    for batch in batches:
        ids, back, counts = np.unique(batch.column(0).to_numpy(), return_inverse=True, return_counts=True)
        many = np.flatnonzero((counts > k)[back] | (np.isin(ids, list(full))[back] if full else False))
        if len(many):
            drop, seen = [], {}
            for i in many.tolist():
                name, value = batch.column(0)[i].as_py(), batch.column(1)[i].values.to_numpy().tobytes()
                seen[name, value] = times = seen.get((name, value), 0) + 1
                if times > k or value in full.get(name, ()):
                    drop.append(i)
            for (name, value), times in seen.items():
                if times >= k:
                    full.setdefault(name, set()).add(value)
            batch = batch.take(pa.array(np.setdiff1d(np.arange(len(batch)), drop)))
        yield batch


def _spread(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A number of each row that depends on its vec_id and its vector."""
    odd = np.arange(1, 2 * v.shape[1] + 1, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    mixed = (v.astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64) + ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(7)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    at = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(axis=1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(axis=1))


def _reaches(score: np.ndarray, norm: np.ndarray, radii: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether rows with these radii around centres with these scores can reach a score."""
    most = score + norm[:, None] * radii
    return most + 1e-9 * np.abs(most) + 1e-6 >= least[:, None]


def _kth(score: np.ndarray, names: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among centres that aren't its own; none if there are fewer."""
    if len(names) < k:
        return np.full(len(ids), -np.inf)
    others = np.where(names == ids[:, None], -np.inf, score)
    return -np.partition(-others, k - 1, axis=1)[:, k - 1]


def _by_dim(batch: pa.RecordBatch):
    """(length, rows, vec_ids, matrix) for each length of vectors."""
    ids, dims = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, ids[at], _matrix(batch.column(1).take(pa.array(at)), dim)


def _share(column: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.shiftrightunsigned(column, 1) / float(1 << 63)


def top_k(spark: SparkSession, data: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, block_rows: tuple[int, int] = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``data`` for each vec_id of ``queries`` (both as of ``integer_vectors``)."""
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    # first level: the distinct vectors with the smallest hashes; only about eight times as many are grouped
    mark = F.xxhash64("v")
    distinct = max(1, data.agg(F.approx_count_distinct(mark)).first()[0])
    some = data.where(_share(mark) < 8.0 * pivots / distinct).groupBy("v").agg(F.min("vec_id").alias("vec_id"))
    chosen = some.orderBy(mark, "v").limit(pivots).select("vec_id", "v").toArrow().combine_chunks()
    tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in chosen.to_batches():
        tops |= {dim: (ids, x.astype(float)) for dim, _, ids, x in _by_dim(batch) if dim}
    below: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def celled(batches):
        """Rows with length, cell, the cell below (0 where there is none), and the distances to both centres."""
        for batch in _thinned(batches, k):
            out = [np.zeros(len(batch), np.int64), np.full(len(batch), -1, np.int64), np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch))]
            for dim, at, _, v in _by_dim(batch):
                out[0][at] = dim
                if dim not in tops:
                    continue
                x = v.astype(float)
                out[1][at], out[3][at] = cell, away = _nearest(x, tops[dim][1])
                low, near = np.zeros(len(at), np.int64), away.copy()
                for c in np.unique(cell).tolist():
                    if (dim, c) in below:
                        rows = np.flatnonzero(cell == c)
                        low[rows], near[rows] = _nearest(x[rows], below[dim, c][1])
                out[2][at], out[4][at] = low, near
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o) for o in out)], names=["vec_id", "v", "dim", "cell", "low", "away", "near"])

    cells_shape = "vec_id long, v array<long>, dim long, cell long, low long, away double, near double"
    first = data.mapInArrow(celled, cells_shape)
    top_stats = first.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.approx_count_distinct(mark).alias("distinct")).collect()  # at most pivots + lengths
    wide = min(block_rows[1], max(block_rows[0], sum(s.n for s in top_stats) // 64))
    stats = [(s.dim, s.cell, 0, s.n, s.radius) for s in top_stats]
    reach = {(s.dim, s.cell): s.radius for s in top_stats}

    # second level: centres out of the cells that are more than a block
    wanted = {(s.dim, s.cell): min(pivots, 2 * -(-s.n // wide)) for s in top_stats if s.n > wide and s.cell >= 0 and s.radius > 0}
    fit = min(1.0, CENTRE_BYTES / max(1, sum(8 * dim * m for (dim, _), m in wanted.items())))
    plans = [(dim, cell, max(1, int(m * fit))) for (dim, cell), m in wanted.items()]
    if plans:
        sizes = {(s.dim, s.cell): s.distinct for s in top_stats}
        aim = spark.createDataFrame([(d, c, m, 8.0 * m / sizes[d, c]) for d, c, m in plans], "dim long, cell long, m long, part double")
        each = Window.partitionBy("dim", "cell").orderBy("mark", "v")  # some 8 m rows each
        centres = (
            first.join(F.broadcast(aim), ["dim", "cell"])  # at most one row for each pivot
            .withColumn("mark", mark)
            .where(_share(F.col("mark")) < F.col("part"))
            .groupBy("dim", "cell", "m", "mark", "v")
            .agg(F.min("vec_id").alias("vec_id"))
            .withColumn("i", F.row_number().over(each))
            .where("i <= m")
        )
        found = centres.select("dim", "cell", "vec_id", "v").orderBy("dim", "cell", "mark", "v").toArrow().combine_chunks()
        keys = np.stack([found.column("dim").to_numpy(), found.column("cell").to_numpy()], axis=1)
        for dim, cell in np.unique(keys, axis=0).tolist():
            at = np.flatnonzero((keys == (dim, cell)).all(axis=1))
            own = found.take(pa.array(at))
            below[dim, cell] = (own.column("vec_id").to_numpy(), _matrix(own.column("v"), dim).astype(float))
        second = data.mapInArrow(celled, cells_shape).groupBy("dim", "cell", "low").agg(F.count("*").alias("n"), F.max("near").alias("radius"))
        stats = [tuple(s) for s in second.collect()]  # at most one row for each centre

    # small cells share a block: blocks are numbered over the cells, about ``wide`` rows each
    block_of: dict[tuple[int, int, int], tuple[int, int]] = {}
    number, filled, last = 0, 0, None
    for dim, cell, low, n, _ in sorted(stats):
        cut = -(-n // wide)
        if cut > 1 or last != dim or filled + n > wide:
            number, filled = number + 1, 0
        block_of[dim, cell, low] = (number, cut)
        filled, last = filled + n, dim
        if cut > 1:
            number, last = number + cut - 1, None
    # by length and cell: the cells below it with their radii, first blocks and numbers of blocks
    leaves: dict[int, dict[int, list[np.ndarray]]] = {}
    for dim, cell, low, _, radius in sorted(stats):
        leaves.setdefault(dim, {}).setdefault(cell, []).append((low, radius, *block_of[dim, cell, low]))
    leaves = {dim: {cell: [np.array(x) for x in zip(*rows, strict=True)] for cell, rows in cells.items()} for dim, cells in leaves.items()}
    groups = max(1, -(-queries.count() // QUERY_ROWS))

    def placed(batches):
        for batch in celled(batches):
            block = np.zeros(len(batch), np.int64)
            cell, low = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for dim, at, ids, v in _by_dim(batch):
                put = np.array([block_of[dim, c, w] for c, w in zip(cell[at].tolist(), low[at].tolist(), strict=True)], np.int64)
                block[at] = put[:, 0] + (_spread(ids, v) % put[:, 1].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block)], names=["vec_id", "v", "block"])

    def asked(batches):
        for batch in batches:
            at, blocks, floor = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.full(len(batch), -np.inf)

            def ask(rows: np.ndarray, firsts: np.ndarray, cuts: np.ndarray) -> None:
                at.append(np.repeat(rows, cuts))
                blocks.append(np.repeat(firsts - np.cumsum(cuts) + cuts, cuts) + np.arange(cuts.sum()))

            for dim, rows, ids, v in _by_dim(batch):
                cells = leaves.get(dim, {})
                if dim not in tops:
                    for _, _, firsts, cuts in cells.values():
                        ask(np.repeat(rows, len(firsts)), np.tile(firsts, len(rows)), np.tile(cuts, len(rows)))
                    continue
                q = v.astype(float)
                names, c = tops[dim]
                score, norm = q @ c.T, np.sqrt((q * q).sum(axis=1))
                least = _kth(score, names, ids, k)
                inner = [x for x in cells if (dim, x) in below]
                if inner:
                    best = np.array(inner)[(score[:, inner] + norm[:, None] * np.array([reach[dim, x] for x in inner])).argmax(axis=1)]
                    for x in np.unique(best).tolist():
                        of = np.flatnonzero(best == x)
                        names, c = below[dim, x]
                        least[of] = np.maximum(least[of], _kth(q[of] @ c.T, names, ids[of], k))
                floor[rows] = least - 1e-9 * np.abs(least) - 1e-6
                for x, (lows, radii, firsts, cuts) in cells.items():
                    of = np.flatnonzero(_reaches(score[:, [x]], norm, np.array([reach[dim, x]]), least)[:, 0])
                    if (dim, x) in below:
                        hit, leaf = np.nonzero(_reaches(q[of] @ below[dim, x][1][lows].T, norm[of], radii, least[of]))
                        of = of[hit]
                    else:
                        leaf = np.zeros(len(of), np.int64)
                    ask(rows[of], firsts[leaf], cuts[leaf])
            pairs = np.unique(np.stack([np.concatenate(at), np.concatenate(blocks)], axis=1), axis=0)  # cells share blocks
            rows = pa.array(pairs[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pairs[:, 1]), pa.array(floor[pairs[:, 0]])], names=["vec_id", "v", "block", "least"])

    shape = "vec_id long, v array<long>, block long"
    put = written(queries.mapInArrow(asked, f"{shape}, least double").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), spark)
    needed = put.select(F.col("block").alias("asked_block"), F.col("part").alias("asked_part")).distinct()
    held = data.mapInArrow(placed, shape).join(needed, F.col("block") == F.col("asked_block")).select("vec_id", "v", "block", F.col("asked_part").alias("part"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            found, ids = (np.zeros(0, np.int64),) * 3, np.zeros(0, np.int64)
        else:
            dim = len(left.column("v")[0])
            ids = right.column("vec_id").to_numpy()
            found = search(_matrix(right.column("v"), dim), ids, _matrix(left.column("v"), dim), left.column("vec_id").to_numpy(), k, right.column("least").to_numpy())
        return pa.table({"query_id": pa.array(ids[found[0]], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    each = held.groupBy("block", "part").cogroup(put.groupBy("block", "part")).applyInArrow(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(spark, vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
