"""Centroid clustering by exponion search against a plain version."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exponion


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("v", "cluster", "upper", "lower", "name", "distance")})


def plain(rows, k=16, rounds=3, scale=64, dim=64):
    """(vec_id, cluster, distance, inertia of the cluster, of all, hash) of each row, by all distances."""
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        own = [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, at) in zip(kept, own, strict=True) if at == j]
                if mine:
                    centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    each = [sum(d for d, at in own if at == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(map(str, ((i, j, d, each[j], sum(each), sha[j]) for (i, _), (d, j) in zip(kept, own, strict=True))))


def cases(seed):
    rng = np.random.default_rng(seed)
    if seed == 0:  # clusters
        points = rng.normal(size=(20, 64))[rng.integers(0, 20, 400)] + rng.normal(size=(400, 64)) * 0.1
    elif seed == 1:  # a coarse grid: many ties, equal rows and equal centroids
        points = np.repeat(rng.integers(-1, 2, (400, 4)), 16, axis=1) / 64
    else:
        points = rng.normal(size=(400, 64))
    rows = [(i, p.tolist()) for i, p in enumerate(points.astype(np.float32))]
    bad = [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [math.nan] + [0.0] * 63), (904, [math.inf] + [0.0] * 63), (905, [])]
    return rows + bad + [rows[3], rows[3], (None, rows[5][1]), (3, rows[7][1])]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_brute_force(spark, seed):
    rows = cases(seed)
    got = exponion.with_inertia(spark, *exponion.clustered(spark, exponion.integer_vectors(frame(spark, rows))))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)


def test_sql_on_hard_rows(spark):
    rows = cases(1)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}))
    assert sorted(map(str, con.sql(exponion.ORACLE).fetchall())) == plain(rows)


def test_other_sizes(spark):
    rows = cases(0)[:9]
    for k, rounds in ((16, 2), (1, 1), (3, 5)):
        got = exponion.with_inertia(spark, *exponion.clustered(spark, exponion.integer_vectors(frame(spark, rows)), k, rounds))
        assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows, k, rounds)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exponion.with_inertia(spark, *exponion.clustered(spark, exponion.integer_vectors(none))).count() == 0


def test_bounds_save_distances_and_stay_exact():
    rng = np.random.default_rng(7)
    centres = rng.integers(-900, 900, (64, 8))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 8))
    x[:50] = (centres[:50] + centres[1:51]) // 2
    own, upper, lower = np.full(5000, -1), np.full(5000, np.inf), np.full(5000, -np.inf)
    points, before = centres + rng.integers(-30, 30, centres.shape), None
    total = 0
    for step in range(8):
        own, upper, lower, cost = exponion.assign(x, own, upper, lower, exponion.Centroids(points, before))
        square = ((x[:, None] - points[None]) ** 2).sum(axis=2)
        assert (own == square.argmin(axis=1)).all()
        exact = np.sqrt(square.astype(float))
        assert (upper >= exact[np.arange(5000), own] - 1e-6).all()
        exact[np.arange(5000), own] = np.inf
        assert (lower <= exact.min(axis=1) + 1e-6).all()
        total += cost if step else 0
        before, points = points, points + rng.integers(-3, 4, points.shape)
    assert total < 7 * 5000 * 64 / 4
    huge = np.array([[1 << 30, 0], [-(1 << 30), 5]])
    assert exponion._squares(huge, huge).tolist() == [[0, (1 << 62) + 25], [(1 << 62) + 25, 0]]
