"""The neighbour estimate of mutual information against all pairs in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbours, stats


def psi(m):
    return sum(1 / i for i in range(1, m)) - 0.5772156649015329


def plain(x, y, k=3):
    keep = np.isfinite(x) & np.isfinite(y)
    x, y = x[keep], y[keep]
    if len(x) < k + 2 or x.std() == 0 or y.std() == 0:
        return 0.0
    x, y = (np.round((v - float(np.float32(v.min()))) / float(np.float32(v.std())) * 2**32).astype(np.int64) for v in (x, y))
    sums = []
    for i in range(len(x)):
        dx, dy = abs(x - x[i]), abs(y - y[i])
        r = np.sort(np.delete(np.maximum(dx, dy), i))[k - 1]
        m = ((dx == 0) & (dy == 0)).sum() if r == 0 else k
        sums.append(psi(m) - psi((dx < max(r, 1)).sum()) - psi((dy < max(r, 1)).sum()))
    return max(0.0, psi(len(x)) + float(np.mean(sums)))


def cases():
    rng = np.random.default_rng(11)
    a = rng.normal(size=2000)
    yield "related", a, a + rng.normal(size=2000), 64
    yield "ties in both", rng.integers(0, 9, 2000).astype(float), rng.integers(0, 4, 2000).astype(float), 8
    grid = rng.integers(0, 40, 2000).astype(float)
    yield "mixed", np.where(rng.random(2000) < 0.4, 5.0, a), np.where(rng.random(2000) < 0.5, grid, a * 3), 32
    yield "hot value", np.where(rng.random(2000) < 0.4, 0.0, rng.exponential(size=2000) ** 4), a, 16
    yield "far away", np.append(a[:300], [1e6, 1e6 + 1, -1e5]), np.append(a[:300] ** 2, [0.0, 5.0, 7.0]), 10
    yield "few", np.array([1.0, 2.0, 4.0, 8.0, 9.0]), np.array([1.0, 1.0, 2.0, 3.0, 5.0]), 1
    yield "independent", a, rng.permutation(a), 100


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
def test_equals_all_pairs(spark, case):
    _, x, y, leaf = case
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y, strict=True)], "x double, `y.y` double").repartition(3)
    for k in (3, 1):
        got = neighbours.neighbour_information(df, "x", "y.y", k, leaf).first()[0]
        assert got == pytest.approx(plain(x, y, k), abs=1e-9)


def test_hard_rows(spark):
    rows = [(1.0, 2.0), (None, 1.0), (1.0, math.nan), (math.inf, 1.0)] * 5
    df = spark.createDataFrame(rows, "x double, y double")
    assert neighbours.neighbour_information(df, "x", "y").first()[0] == 0 and neighbours.neighbour_information(df.where("false"), "x", "y").first()[0] == 0
    assert stats.ANALYZERS["mutual_information"] is neighbours.neighbour_information
    numbers = [1, 2, 9, 16, 17, 30, 1000]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(neighbours.digamma(F.col("n"))).collect()
    assert [r[0] for r in got] == pytest.approx([psi(n) for n in numbers], abs=1e-11)


def test_no_leaf_holds_a_hot_strip(spark):
    """Half of all points share one x: their leaves are cut by y."""
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 7L, id * 1000) as x", "id * 31 % 4001 as y", "1L as n", "id")
    leaves = neighbours.Leaves.of(df, 64)
    place = leaves.place(*(np.array([r[c] for r in df.collect()]) for c in ("x", "y")))
    assert np.bincount(place).max() <= 200 and place.max() < leaves.first[-1]
