"""Boosted ensembles against plain versions, and models that grow by chunk and by micro-batch."""

import math
import time

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import queries
from tidemark.operators import boosting, training
from tidemark.sources import sinks
from tidemark.streaming.chunks import train_on_stream


class Plain:
    """The same algorithm over NumPy arrays of all rows, with float sums and nested questions."""

    def __init__(self, trees, depth, rate, bins=64, l2=0.0):
        self.n, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.trees, self.start = [], 0.0

    def fit(self, x, y, w):
        if not len(y):
            return
        if not self.trees:
            self.start = (w * y).sum() / w.sum()
        edges = []
        for col in x.T:
            col = np.sort(col[~np.isnan(col)])
            edges.append(sorted({col[max(0, math.ceil(i / self.bins * len(col)) - 1)] for i in range(1, self.bins)}) if len(col) else [])
        left = y - self.score(x)
        for _ in range(self.n):
            parts = [np.arange(len(y))]
            levels = []
            for _ in range(self.depth):
                best = (0.0, None, None)
                for f in range(x.shape[1]):
                    for t in edges[f]:
                        gain = 0.0
                        for p in parts:
                            below = x[p, f] <= t
                            gain += sum(self._value(left, w, q) for q in (p[below], p[~below])) - self._value(left, w, p)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, f, t)
                if best[1] is None:
                    break
                _, f, t = best
                levels.append(best)
                parts = [p[x[p, f] <= t] for p in parts] + [p[~(x[p, f] <= t)] for p in parts]
            leaf = [self.rate * (left[p] * w[p]).sum() / (w[p].sum() + self.l2) if len(p) and w[p].sum() > 0 else 0.0 for p in parts]
            for p, v in zip(parts, leaf, strict=True):
                left[p] -= v
            self.trees.append((levels, leaf))

    def _value(self, left, w, p):
        total = w[p].sum()
        return (left[p] * w[p]).sum() ** 2 / (total + self.l2) if len(p) and total > 0 else 0.0

    def score(self, x):
        out = np.full(len(x), self.start)
        for levels, leaf in self.trees:
            for i, row in enumerate(x):
                place = 0
                for level, (_, f, t) in enumerate(levels):
                    place += 0 if row[f] <= t else 1 << level
                out[i] += leaf[place]
        return out


def rows_of(seed, n, missing=True):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.exponential(size=n).round(1)], axis=1)
    if missing:
        x[::11, 0] = np.nan
    y = np.where(x[:, 1] > 1, np.nan_to_num(x[:, 0]), -x[:, 2]) + rng.normal(size=n) * 0.1
    return x, y, rng.integers(0, 5, n).astype(float)


def frame(spark, x, y, w, parts=3):
    rows = [(None if np.isnan(a) and i % 2 else float(a), float(b), float(c), float(q), float(v)) for i, ((a, b, c), q, v) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "a double, `odd name.b` double, c double, label double, weight double").repartition(parts)


NAMES = ["a", "odd name.b", "c"]


@pytest.mark.parametrize(("trees", "depth", "rate", "l2"), [(4, 3, 0.3, 0.0), (3, 2, 1.0, 2.0), (1, 5, 0.5, 0.0)])
def test_equals_a_plain_version(spark, monkeypatch, trees, depth, rate, l2):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    monkeypatch.setattr(boosting, "ROUNDS", 2)
    model, plain = boosting.HistogramBooster(NAMES, trees, depth, rate, l2=l2), Plain(trees, depth, rate, l2=l2)
    for seed in (1, 2):
        x, y, w = rows_of(seed, 300)
        assert model.partial_fit(frame(spark, x, y, w))
        plain.fit(x, y, w)
        assert len(model.trees) == len(plain.trees)
        for (levels, _), feature, threshold in zip(plain.trees, model.trees.feature, model.trees.threshold, strict=True):
            assert [(f, t) for _, f, t in levels] == list(zip(feature.tolist(), threshold.tolist(), strict=True))[: len(levels)]
    x, y, w = rows_of(3, 200)
    got = model.predict(frame(spark, x, y, w).coalesce(1)).select("label", "score").collect()
    want = dict(zip(y.tolist(), plain.score(x).tolist(), strict=True))
    assert [r.score for r in got] == pytest.approx([want[r.label] for r in got], abs=1e-9)
    gains = np.zeros(3)
    for levels, _ in plain.trees:
        for gain, f, _ in levels:
            gains[f] += gain
    shares = {r.feature_name: r.importance for r in model.importances(spark).collect()}
    assert [shares[n] for n in NAMES] == pytest.approx((gains / gains.sum()).tolist(), abs=1e-9)


def test_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    x, y, w = rows_of(5, 400)
    models = []
    for parts, block in ((1, 1 << 16), (7, 10)):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        model = boosting.HistogramBooster(NAMES, 6, 4, 0.1)
        model.partial_fit(frame(spark, x, y, w, parts))
        models.append(model)
    a, b = (m.trees for m in models)
    assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and np.allclose(a.leaf, b.leaf, atol=1e-12)


def test_hard_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, None, 1.0), (1.0, math.nan, 1.0), (1.0, 4.0, None), (1.0, 8.0, -1.0), (None, 6.0, 1.0)], "a double, label double, weight double")
    model = boosting.HistogramBooster(["a"], 2, 2, 1.0)
    assert model.partial_fit(df) and model.start == 4.0  # of the rows with 2 and 6
    assert [r.score for r in model.predict(df.coalesce(1)).collect()] == [2.0] * 5 + [6.0]
    assert not model.partial_fit(df.where("false")) and len(model.trees) == 2
    flat = boosting.HistogramBooster(["a"], 2, 2, 0.5)
    assert flat.partial_fit(df.selectExpr("1.0 as a", "3.0 as label", "1.0 as weight"))
    assert {r.score for r in flat.predict(df).collect()} == {3.0}
    assert flat.predict(df.where("false")).count() == 0
    infinite = spark.createDataFrame([(math.inf, 1.0, 1.0), (-math.inf, 0.0, 1.0), (0.0, 0.0, 1.0)], "a double, label double, weight double").coalesce(1)
    model = boosting.HistogramBooster(["a"], 1, 1, 1.0)
    model.partial_fit(infinite)
    assert [r.score for r in model.predict(infinite).collect()] == pytest.approx([1.0, 0.0, 0.0])
    with pytest.raises(ValueError):
        boosting.HistogramBooster(["a"], learning_rate=0)


def test_every_call_adds_trees(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), 1.0) for i in range(40)], "a double, label double, weight double").coalesce(1)
    model = training.build_model("residual_boosting", "regression", ["a"], trees_per_call=120, max_depth=1)
    for calls in (1, 2):
        model.partial_fit(df)
        assert len(model.trees) == 120 * calls
    capped = training.build_model("residual_boosting", "regression", ["a"], trees_per_call=2, max_depth=1, max_trees=3)
    capped.partial_fit(df)
    with pytest.raises(ValueError, match="max_trees"):
        capped.partial_fit(df)
    assert len(capped.trees) == 2


def test_large_ensembles_score_in_groups(spark):
    rng = np.random.default_rng(4)
    n, depth = 3000, 5
    model = boosting.HistogramBooster(["a", "b"], max_depth=depth)
    model.trees = boosting.Trees(rng.integers(0, 2, (n, depth)).astype(np.int32), rng.normal(size=(n, depth)), rng.normal(size=(n, 1 << depth)) * 0.01, np.zeros((n, depth)))
    df = spark.range(2000).selectExpr("id", "sin(id) as a", "if(id % 7 = 0, null, cos(id)) as b").coalesce(2)
    began = time.perf_counter()
    planned = model.predict(df)
    assert time.perf_counter() - began < 2
    got = {r.id: r.score for r in planned.collect()}
    for i in range(0, 2000, 199):
        row, sum_ = (math.sin(i), math.nan if i % 7 == 0 else math.cos(i)), 0.0
        for feature, threshold, leaf in zip(model.trees.feature, model.trees.threshold, model.trees.leaf, strict=True):
            sum_ += leaf[sum((0 if row[f] <= t else 1) << k for k, (f, t) in enumerate(zip(feature, threshold, strict=True)))]
        assert got[i] == pytest.approx(sum_, abs=1e-9)
    grouped = model.predict(df, ["id"], group_bytes=model.trees.nbytes // 4)
    assert grouped.columns == ["id", "score"] and len(model.trees.groups(model.trees.nbytes // 4)) > 3
    assert {r.id: r.score for r in grouped.collect()} == pytest.approx(got, abs=1e-9)


@pytest.fixture(scope="module")
def small_rows(spark):
    """The rows that the registered queries train on, chunk by chunk, and all rows."""
    found = []
    real = boosting.HistogramBooster.partial_fit
    try:
        boosting.HistogramBooster.partial_fit = lambda self, df, *a: found.append(df.toPandas()) or real(self, df, *a)
        pipeline = queries._trained(spark, "/root/testdata/sf0.001")
    finally:
        boosting.HistogramBooster.partial_fit = real
    return pipeline, found


def test_registered_model_equals_a_plain_version(spark, small_rows):
    pipeline, chunks = small_rows
    names = pipeline.names
    plain = Plain(pipeline.model.trees_per_call, pipeline.model.max_depth, pipeline.model.learning_rate)
    for c in chunks:
        plain.fit(c[names].to_numpy(float), c["label"].to_numpy(float), c["weight"].to_numpy(float))
    rows = pipeline.rows().toPandas()
    want = dict(zip(rows["seq"].tolist(), plain.score(rows[names].to_numpy(float)).tolist(), strict=True))
    got = {r.seq: r.score for r in entry.queries()["boosted_predictions"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) > 200 and got.keys() == want.keys()
    assert [got[k] for k in got] == pytest.approx([want[k] for k in got], rel=1e-5, abs=1e-5)
    gains = np.zeros(len(names))
    for levels, _ in plain.trees:
        for gain, f, _ in levels:
            gains[f] += gain
    shares = {r.feature_name: r.importance for r in entry.queries()["feature_importance"](spark, "/root/testdata/sf0.001").collect()}
    assert [shares[n] for n in names] == pytest.approx((gains / gains.sum()).tolist(), abs=1e-6)


def test_scores_by_probability(spark):
    df = spark.createDataFrame([(float(i), float(i > 20), 1.0) for i in range(40)], "a double, label double, weight double")
    model = training.ProbabilityModel(["a"], LogisticRegression()).partial_fit(df)
    got = {r.a: r.score for r in model.predict_proba(df).collect()}
    assert got[0.0] < 0.1 and got[39.0] > 0.9 and model.predict_proba(df).columns == [*df.columns, "score"]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "state")
    df = spark.createDataFrame([(float(i % 7), float(i % 3), 1.0) for i in range(40)], "a double, label double, weight double").coalesce(1)

    def run(model, repeated=False):
        calls = []
        real = model.partial_fit
        model.partial_fit = lambda rows: calls.append(1) or real(rows)
        if repeated:  # as if the stream had failed after training and before its own commit
            (tmp_path / "state" / "commits" / "0").unlink()
            (tmp_path / "state" / "commits" / ".0.crc").unlink(missing_ok=True)
        query = train_on_stream(spark.readStream.schema(df.schema).parquet(source), lambda x: x, model, place)
        query.processAllAvailable()
        query.stop()
        return len(calls)

    def fresh():
        return training.build_model("residual_boosting", "regression", ["a"], trees_per_call=3, max_depth=1)

    df.write.mode("append").parquet(source)
    assert run(first := fresh()) == 1 and first.epoch == 0
    assert run(again := fresh(), repeated=True) == 0 and len(again.trees) == 3
    df.write.mode("append").parquet(source)
    assert run(more := fresh()) == 1 and len(more.trees) == 6
    # each batch has left its own trees only, and all parts are the model
    parts = [f"{place}/models/{name}" for name in sinks.file_names(spark, f"{place}/models")]
    assert [spark.read.parquet(f"{p}/trees").count() for p in parts] == [3, 3]
    whole = boosting.HistogramBooster.load(spark, *parts)
    assert [r.score for r in whole.predict(df).collect()] == [r.score for r in more.predict(df).collect()]
    with pytest.raises(ValueError):
        boosting.HistogramBooster.load(spark, parts[1])
    assert df.select(F.lit(1)).count() == 40
