"""In-sample R2 of trees against a plain version that grows them by the definition."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.queries import Q, tables

SMALL = "/root/testdata/sf0.001"


def grown(x, y, depth):
    """Predictions of a regression tree: each node is cut where the squared error falls most, between neighbouring values."""
    out = np.full(len(y), y.mean())
    best = None
    if depth:
        for f in range(x.shape[1]):
            for low in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= low
                error = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
                if best is None or error < best[0] - 1e-9:
                    best = error, left
    if best is not None and best[0] < ((y - y.mean()) ** 2).sum() - 1e-9:
        for part in (best[1], ~best[1]):
            out[part] = grown(x[part], y[part], depth - 1)
    return out


def r2(y, predicted):
    return 1 - ((y - predicted) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_one_tree_equals_a_plain_version(spark, depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 12, (240, 2)).astype(float)  # few values, so each of them is a bin
    y = np.where(x[:, 0] > 6, x[:, 1], -2 * x[:, 0]) + rng.normal(size=240)
    df = spark.createDataFrame([(*a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)], "a double, b double, y double")
    df = df.union(spark.createDataFrame([(None, 1.0, 9.0), (1.0, float("nan"), 9.0)], df.schema))  # take no part
    tree = RandomForestRegressor(numTrees=1, maxDepth=depth, bootstrap=False, seed=42)
    assert stats.model_r2(df, ["a", "b"], "y", tree).first()[0] == pytest.approx(r2(y, grown(x, y, depth)), abs=1e-9)


def test_registered_forest_by_its_trees(spark):
    """The query's R2 is that of the mean of its 50 trees, each walked by hand over every trade."""
    trades = tables(spark, SMALL)["trades"]
    rows = trades.select(F.col("price").cast("double").alias("price"), F.col("amount").cast("double").alias("label")).dropna()
    data = VectorAssembler(inputCols=["price"], outputCol="features").transform(rows)
    forest = RandomForestRegressor(numTrees=50, maxDepth=5, seed=42).fit(data)
    assert forest.getNumTrees == 50
    some = rows.toPandas()

    def walked(node, x):
        if node.subtreeDepth() == 0:
            return np.full(len(x), node.prediction())
        left = x <= node.split().threshold()
        out = np.empty(len(x))
        out[left], out[~left] = walked(node.leftChild(), x[left]), walked(node.rightChild(), x[~left])
        return out

    mean = np.mean([walked(tree._call_java("rootNode"), some["price"].to_numpy()) for tree in forest.trees], axis=0)
    assert Q["tree_r2"](spark, SMALL).first().r2 == pytest.approx(r2(some["label"].to_numpy(), mean), abs=1e-6)
