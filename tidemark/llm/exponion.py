"""Centroid clustering (Lloyd's rounds) with exponion search.

Components become integers floor(scale * x), so distances, sums and ties are exact. The first centroids are the ``k`` rows
with the smallest SHA-256 of ``seed:vec_id``. A round assigns every row to its nearest centroid (ties: the smaller number)
and replaces each centroid that has rows by the componentwise floor of their mean. After the rounds rows are assigned once more.

Rows keep their centroid, an upper bound on the distance to it and a lower bound on the distance to any other. When
centroids move, the bounds widen by what they moved. A row is left alone if its upper bound is below its lower bound, or
below half the distance s from its centroid to the next. Otherwise, with u its exact distance, no centroid
farther than 2 u + s from its own can be as near as its own, and one within that ball is the second nearest: only the ball is scanned,
by lists of each centroid's others in order of distance, in steps of powers of two. The ball includes its surface and
the comparisons have a margin for rounding, so equal distances are always compared exactly.

A round is one pass over the rows in Arrow batches and one aggregate with as many groups as centroids; each round's rows and bounds are
written to the shared folder. The driver holds ``k`` centroids and their ``k`` by ``k`` distances, nothing else.

Rows whose vector is null, has another length than ``dim``, or holds null or non-finite components take no part. Rows that
repeat, also with one vec_id, are vectors each; among first centroids they are ordered by their vectors. A null vec_id
hashes as an empty one. With fewer than ``k`` rows there are as many centroids as rows. Equal centroids are all kept; rows
go to the one with the smallest number. Squared distances and sums must fit 64 bits. An empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import table, written

K, ROUNDS, SCALE, DIM, SEED = 16, 3, 64, 64, 1
BATCH_ROWS = 4096
_STATE = ["cluster", "upper", "lower"]


def integer_vectors(vectors: DataFrame, scale: int = SCALE, dim: int = DIM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, of the rows that take part."""
    fine = (F.size(vector_col) == dim) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * float(scale))).alias("v"))


class Centroids:
    """Centroids with what a search needs of them: distances to each other, each one's others by distance, what each has moved."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points.astype(np.int64)
        apart = np.sqrt(((self.points[:, None] - self.points[None]).astype(np.float64) ** 2).sum(axis=2))
        self.order = np.argsort(apart, axis=1, kind="stable")
        # a centroid comes first in its own list, also where another one equals it
        for j, row in enumerate(self.order):
            at = int(np.flatnonzero(row == j)[0])
            row[1 : at + 1] = row[:at].copy()
            row[0] = j
        self.sorted = np.take_along_axis(apart, self.order, axis=1)
        self.next = self.sorted[:, 1] if len(points) > 1 else np.full(len(points), np.inf)
        moved = np.zeros(len(points)) if before is None else np.sqrt(((self.points - before).astype(np.float64) ** 2).sum(axis=1))
        self.moved = moved * (1 + 1e-9)
        largest = np.argsort(-self.moved, kind="stable")
        self.others_moved = np.full(len(points), self.moved[largest[0]])
        self.others_moved[largest[0]] = self.moved[largest[1]] if len(points) > 1 else 0.0


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``."""
    size = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * size * size * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid and bounds, from those for the centroids before (own -1: none yet); and how many distances were computed."""
    n, k = len(x), len(at.points)
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    known = own >= 0
    some = own[known]
    upper[known] += at.moved[some]
    lower[known] -= at.others_moved[some]
    free = np.maximum(lower, np.where(known, at.next[own] / 2, -np.inf))
    far = np.flatnonzero(~known | (upper * (1 + 1e-9) + 1e-9 >= free))
    cost = 0
    new = far[own[far] < 0]
    old = far[own[far] >= 0]
    if len(old):  # tighten the upper bound, which may be enough
        exact = ((x[old] - at.points[own[old]]) ** 2).sum(axis=1)
        upper[old] = np.sqrt(exact.astype(np.float64))
        cost += len(old)
        old = old[upper[old] * (1 + 1e-9) + 1e-9 >= free[old]]
    groups = [(new, np.arange(k))] if len(new) else []
    for j in np.unique(own[old]).tolist():
        mine = old[own[old] == j]
        radius = (2 * upper[mine] + at.next[j]) * (1 + 1e-9) + 1e-9
        inside = np.searchsorted(at.sorted[j], radius, "right")
        step = np.minimum(1 << np.ceil(np.log2(inside)).astype(np.int64), k)
        groups += [(mine[step == m], np.sort(at.order[j, :m])) for m in np.unique(step).tolist()]
    for rows, names in groups:
        square = _squares(x[rows], at.points[names])
        cost += square.size
        best = square.argmin(axis=1)  # the first of equal ones, which has the smallest number
        own[rows] = names[best]
        each = np.arange(len(rows))
        upper[rows] = np.sqrt(square[each, best].astype(np.float64))
        if len(names) > 1:
            square[each, best] = np.iinfo(np.int64).max
            lower[rows] = np.sqrt(square.min(axis=1).astype(np.float64))
        else:
            lower[rows] = np.inf if k == 1 else at.next[own[rows]] - upper[rows]
    return own, upper, lower, cost


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def _pass(rows: DataFrame, at: Centroids, dim: int, last: bool) -> DataFrame:
    """``rows`` (vec_id, v, cluster, upper, lower) assigned to the centroids ``at``; at the ``last`` pass with the exact distance instead of v and bounds."""
    kind = dict(rows.dtypes)["vec_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), BATCH_ROWS):
                batch = whole.slice(begin, BATCH_ROWS)
                x = _matrix(batch.column(1), dim)
                own, upper, lower, _ = assign(x, *(batch.column(i).to_numpy() for i in (2, 3, 4)), at)
                if last:
                    square = ((x - at.points[own]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(square)], names=["vec_id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, (own, upper, lower))], names=["vec_id", "v", *_STATE])

    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long" if last else f"vec_id {kind}, v array<long>, cluster int, upper double, lower double")


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the ``k`` rows (which are few) with the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()], np.int64)


def _means(rows: DataFrame, before: np.ndarray) -> np.ndarray:
    """The floors of the means of each cluster's rows; a cluster without rows keeps its centroid."""
    after = before.copy()
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(before.shape[1])))
    for r in sums.collect():  # one row for each centroid
        after[r.cluster] = [r[f"s{i}"] // r.n for i in range(before.shape[1])]
    return after


def clustered(spark: SparkSession, vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of every row of ``vectors`` (as of ``integer_vectors``), and the final centroids."""
    start = (F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower"))
    now = first_centroids(vectors, k, seed)
    if not len(now):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    rows, at, dim = vectors.select("vec_id", "v", *start), Centroids(now), now.shape[1]
    for _ in range(rounds):
        rows = written(_pass(rows, at, dim, last=False), spark)
        now = _means(rows, at.points)
        at = Centroids(now, at.points)
    return written(_pass(rows, at, dim, last=True), spark), now


def with_inertia(spark: SparkSession, found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256."""
    names = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    per = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row for each centroid
    about = spark.createDataFrame([(j, per.get(j, 0), sum(per.values()), name) for j, name in names], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(spark, *clustered(spark, integer_vectors(table(spark, sf_dir, "embeddings"))))


def _oracle(k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED) -> str:
    """All distances, round after round."""
    square = "list_sum(list_transform(range(1, {dim} + 1), lambda i: (r.v[i] - c.v[i]) * (r.v[i] - c.v[i])))".replace("{dim}", str(dim))
    sql = f"""
WITH r AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM r QUALIFY c < {k})"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT row, vec_id, c.c AS c, CAST({square} AS BIGINT) AS d, r.v AS v FROM r, c{i} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c.c) = 1)"""
        if i < rounds:
            sql += f""",
m{i} AS (
  SELECT c, pos, CAST(sum(x)::HUGEINT // count(*) AS BIGINT) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END AS x
  FROM (SELECT c, unnest(v) AS x, unnest(range(1, {dim} + 1)) AS pos FROM a{i}) GROUP BY c, pos),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(x ORDER BY pos) AS v FROM m{i} GROUP BY c) n ON n.c = c.c)"""
    return sql + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


ORACLE = _oracle()
