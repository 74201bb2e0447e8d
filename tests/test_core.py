"""Sources, chunks, expressions, validation, evaluation, statistics, training, streaming and the registry."""

import importlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from tidemark.functions import exprs
from tidemark.functions.exprs import SECOND
from tidemark.operators import boosting, evaluation, stats, training, validation
from tidemark.operators.features import Spec
from tidemark.plans.prefix import running
from tidemark.sources import sinks
from tidemark.sources.catalog import Catalog, Source
from tidemark.streaming import chunks as stream

SMALL = "/root/testdata/sf0.001"


def _ts(spark, values):
    return spark.createDataFrame([(int(v), i) for i, v in enumerate(values)], "timestamp long, seq long")


def test_units():
    assert exprs.to_us(1, "us") == 1 and exprs.to_us(2, "ms") == 2000 and exprs.to_us(1.5, "sec") == 1_500_000
    with pytest.raises(ValueError):
        exprs.to_us(1, "hour")


def test_chunks_of_a_file(spark, tmp_path):
    _ts(spark, [0, SECOND, 2 * SECOND, 3 * SECOND]).coalesce(1).drop("seq").write.parquet(f"{tmp_path}/a")
    cat = Catalog.of(spark, [Source("a", f"{tmp_path}/a")], window=1)
    assert cat.n_chunks == 4 and cat.end == 3 * SECOND + 1
    assert [r.chunk_id for r in cat.chunked("a").orderBy("timestamp").collect()] == [0, 1, 2, 3]
    assert [r.seq for r in cat.tables["a"].orderBy("timestamp").collect()] == [0, 1, 2, 3]
    assert cat.chunk(2)["a"].count() == 1


def test_chunk_bounds_match_a_loop(spark):
    rng = np.random.default_rng(3)
    a, b = np.sort(rng.integers(0, 1000, 80)), np.sort(rng.integers(100, 900, 60))
    cat = Catalog({"a": _ts(spark, a), "b": _ts(spark, b)}, 97, "us", since=150, until=870, lookback={"a": 40}, lookahead={"a": 25})
    assert (cat.start, cat.end) == (150, 870)
    for name, values, back, ahead in (("a", a, 40, 25), ("b", b, 0, 0)):
        want = []
        for i in range(cat.n_chunks):
            begin = 150 + 97 * i
            stop = min(begin + 97, 870)
            seen = values[(values >= begin - back) & (values < min(stop + ahead, 870))]
            want += [(i, int(v)) for v in seen]
            assert sorted(r.timestamp for r in cat.chunk(i)[name].collect()) == sorted(map(int, seen))
        assert sorted((r.chunk_id, r.timestamp) for r in cat.chunked(name).collect()) == sorted(want)


def test_since_after_the_end_gives_no_chunk(spark):
    assert Catalog({"a": _ts(spark, [1, 2])}, 10, "us", since=50).n_chunks == 0
    with pytest.raises(ValueError):
        Catalog({"a": _ts(spark, [])}, 10, "us")


def test_ranges(spark):
    cat = Catalog({"a": _ts(spark, [0, 3599 * SECOND, 3600 * SECOND, 20 * 86_400 * SECOND])})
    assert [cat.first_hour()["a"].count(), cat.first_day()["a"].count(), cat.first_two_weeks()["a"].count()] == [2, 3, 3]
    assert "PushedFilters" in spark.read.parquet(f"{SMALL}/orders.parquet").where("o_orderkey > 5")._jdf.queryExecution().toString()


def test_guards(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (1.0, nan), (1.0, -2.0)], "a double, b double")
    rows = df.select(exprs.over_positive(F.col("a"), F.col("b")).alias("p"), exprs.over_nonzero(F.col("a"), F.col("b")).alias("n"), exprs.ieee_divide(F.col("a"), F.col("b")).alias("i")).collect()
    assert [r.p for r in rows] == [0.5, 0, 0, 0, 0, 0]
    assert [r.n for r in rows][:4] == [0.5, 0, 0, 0]
    assert [r.i for r in rows][:2] == [0.5, inf] and math.isnan(rows[2].i) and rows[3].i == -inf
    logs = [r[0] for r in spark.createDataFrame([(-2.0,), (-1.0,), (0.0,)], "x double").select(exprs.log1p(F.col("x"))).collect()]
    assert math.isnan(logs[0]) and logs[1] == -inf and logs[2] == 0
    days = spark.createDataFrame([("2026-02-01",)], "d string").select(exprs.utc_date_to_sec(F.col("d")).alias("s"), exprs.us_to_utc_text(exprs.utc_date_to_sec(F.col("d")) * SECOND + 61 * SECOND).alias("t")).first()
    assert days.s == 1769904000 and days.t == "2026-02-01 00:01:01 UTC"


def test_numeric_sides(spark):
    df = spark.createDataFrame([(-3,), (2,)], "side int")
    assert [r[0] for r in df.select(exprs.side_sign(F.col("side"), T.IntegerType())).collect()] == [-1, 1]
    assert [r[0] for r in spark.createDataFrame([("x",), ("buy",)], "side string").select(exprs.side_sign_lenient(F.col("side"), T.StringType())).collect()] == [-1, 1]
    with pytest.raises(Exception, match="side must not"):
        spark.createDataFrame([(0,)], "side int").select(exprs.side_sign(F.col("side"), T.IntegerType())).collect()


def test_validation(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan"), float("inf"), 2)], "timestamp long, a double, b double, c double, mu_a long")
    got = {r.feature: r.status for r in validation.report(df, ["a", "b", "c"]).collect()}
    assert got == {"a": validation.FORWARD, "b": validation.NAN, "c": validation.INF}
    with pytest.raises(ValueError, match="HAS_NANS"):
        validation.require(df.drop("mu_a"), ["a", "b"])
    with pytest.raises(Exception, match="fails validation"):
        validation.guarded(df, ["c"]).collect()
    late = df.withColumn("fts", F.lit(5))
    assert validation.report(late.drop("mu_a"), ["a"], "fts").first().status == validation.MISALIGNED


def test_running_matches_a_sort(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 20, 500)
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(v)], "v long, i long")
    out = running(spark, df, [F.col("v").desc(), F.col("i")], {"s": F.col("v"), "n": F.lit(1)}, 7).orderBy("n").collect()
    want = sorted(((int(x), i) for i, x in enumerate(v)), key=lambda p: (-p[0], p[1]))
    assert [(r.v, r.i) for r in out] == want
    assert [r.s for r in out] == np.cumsum([x for x, _ in want]).tolist()


def test_golden_curve(spark):
    score, pnl = [3, -1, 2, 5, 0, 1, 4, -2, 6, 7], [-3, 2, -1, -6, 1, 0, -5, 2, -8, 4]
    rows = [(i, i, float(s), float(p), 10.0 * (i + 1), True) for i, (s, p) in enumerate(zip(score, pnl, strict=True))]
    df = spark.createDataFrame(rows, "timestamp long, seq long, score double, pnl double, weight double, valid boolean")
    got = {round(r.filter_fraction, 2): r for r in evaluation.evaluate_predictions(spark, df, 1.0).collect()}
    assert len(got) == 31
    for f, kept, gain, filtered, weight in [(0.0, -1.309090909, 0, None, 550), (0.1, -2.488888889, -1.17979798, 4, 450), (0.2, -1.111111111, 0.197979798, -1.684210526, 360), (0.3, -0.5, 0.809090909, -2.434782609, 320)]:
        r = got[f]
        assert r.pnl_kept_bps == pytest.approx(kept) and r.score_bps == pytest.approx(gain, abs=1e-9) and r.kept_turnover_per_day == pytest.approx(weight)
        assert r.pnl_filtered_bps is None if filtered is None else r.pnl_filtered_bps == pytest.approx(filtered)
    assert got[0.0].weighted_rmse_badness_bps == pytest.approx(4.810972308) and got[0.0].weighted_mae_badness_bps == pytest.approx(2.818181818)
    assert evaluation.best_row(evaluation.evaluate_predictions(spark, df, 1.0), least=330).first().kept_turnover_per_day >= 330
    with pytest.raises(ValueError):
        evaluation.eligible(df.withColumn("valid", F.lit(False)))


def test_cut_places_truncate():
    assert int(100 * evaluation.fractions()[29]) == int(100 * (29 * (0.3 / 30)))


def test_statistics(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, 300)
    y = x * 2 + rng.integers(0, 5, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    db = duckdb.connect()
    d = df.toPandas()  # noqa: F841
    assert stats.entropy(df, "x").first()[0] == pytest.approx(db.execute("select entropy(x) from d").fetchone()[0])
    rank = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"
    assert stats.spearman(spark, df, "x", "y").first()[0] == pytest.approx(db.execute(f"select corr(a, b) from (select {rank.format('x')} a, {rank.format('y')} b from d)").fetchone()[0])
    assert stats.linear_r2(df, "x", "y").first()[0] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
    assert stats.ks(spark, df.where("x < 4"), df.where("x >= 4"), "x").first()[0] == 1.0
    related, other = stats.mutual_information(df, "x", "y").first()[0], stats.mutual_information(df.withColumn("z", F.lit(1.0)), "x", "z").first()[0]
    assert related > 0.5 and other == 0
    assert stats.tree_r2(df, ["x"], "y").first()[0] > 0.8


class _Warm:
    warm_start = True

    def __init__(self, n_estimators):
        self.n_estimators, self.history = n_estimators, []

    def fit(self, rows):
        self.history.append(self.n_estimators)


def test_incremental_models(spark):
    for came_with in (1, 5):
        warm = _Warm(came_with)
        assert training.grow(warm, spark.range(3), 5) and training.grow(warm, spark.range(3), 5)
        assert not training.grow(warm, spark.range(0), 5)
        assert warm.history == [5, 10]
    pipeline = _pipeline(spark, _Warm(1))
    pipeline.step = 5
    pipeline.fit(log=lambda _: None)
    assert pipeline.model.history == [5, 10, 15, 20]
    with pytest.raises(ValueError):
        training.grow(object(), spark.range(3))
    with pytest.raises(ValueError):
        training.build_model("other", "regression", [])


def test_booster_learns_and_reloads(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 10), float(i % 3), 3.0 * (i % 10), 1.0) for i in range(300)], "a double, b double, label double, weight double")
    model = boosting.HistogramBooster(["a", "b"], trees_per_call=8, learning_rate=0.3)
    assert model.predict(df).agg(F.max(F.abs("score"))).first()[0] == 0
    before = None
    for _ in range(2):
        model.partial_fit(df)
        rmse = model.predict(df).agg(F.sqrt(F.avg((F.col("score") - F.col("label")) ** 2))).first()[0]
        assert before is None or rmse < before
        before = rmse
    assert len(model.trees) == 16 and before < 2
    assert model.importances(spark).first().feature_name == "a"
    model.save(spark, f"{tmp_path}/m")
    again = boosting.HistogramBooster.load(spark, f"{tmp_path}/m")
    assert [r.score for r in again.predict(df).collect()] == [r.score for r in model.predict(df).collect()]
    assert training.model_file_parts("core_30s") == ("core", 30)


def _pipeline(spark, model):
    rows = [(i * SECOND, i, "buy" if i % 2 else "sell", 100.0, 1.0) for i in range(40)]
    trades = spark.createDataFrame(rows, "timestamp long, seq long, side string, price double, amount double")
    return training.ModelPipeline(model, [Spec("side", "trade_side")], Catalog({"trades": trades}, 10), F.col("sign"), F.lit(1.0))


class _Counting:
    def __init__(self):
        self.calls = []

    def partial_fit(self, rows):
        self.calls.append(rows.count())


def test_pipeline_feeds_chunks(spark):
    model, log, seen = _Counting(), [], []
    assert _pipeline(spark, model).fit(log_every=2, on_chunk=lambda i, _: seen.append(i), log=log.append) == 4
    assert model.calls == [10, 10, 10, 10] and seen == [0, 1, 2, 3] and len(log) == 3
    with pytest.raises(ValueError):
        _pipeline(spark, model).fit(log_every=0)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "feature_name string, importance double")
    sinks.write_csv(df, f"{tmp_path}/c")
    assert sinks.read_csv(spark, f"{tmp_path}/c", df.schema).collect() == df.collect()
    with pytest.raises(ValueError):
        sinks.read_csv(spark, f"{tmp_path}/c", T.StructType([T.StructField("nope", T.StringType())]))
    sinks.write_json(spark, {"a": [1, 2]}, f"{tmp_path}/j")
    assert sinks.read_json(spark, f"{tmp_path}/j") == {"a": [1, 2]}


def test_stream_matches_batch(spark, tmp_path):
    rows = [(i * SECOND, i, "buy" if i % 3 else "sell", 100.0, float(i)) for i in range(30)]
    trades = spark.createDataFrame(rows, "timestamp long, seq long, side string, price double, amount double")
    trades.write.parquet(f"{tmp_path}/in")
    query = stream.flow_per_window(spark.readStream.schema(trades.schema).parquet(f"{tmp_path}/in"), 10).writeStream.outputMode("complete").format("memory").queryName("flow").start()
    query.processAllAvailable()
    query.stop()
    got = {r.start: (r.buy, r.sell, r.n) for r in spark.table("flow").collect()}
    for k in range(3):
        part = [r for r in rows if k * 10 <= r[1] < k * 10 + 10]
        assert got[k * 10 * SECOND] == (sum(100 * r[4] for r in part if r[2] == "buy"), sum(100 * r[4] for r in part if r[2] == "sell"), 10)


def test_stream_trains_by_chunk(spark, tmp_path):
    rows = [(i * SECOND, i, "buy", 100.0, 1.0) for i in range(20)]
    spark.createDataFrame(rows, "timestamp long, seq long, side string, price double, amount double").write.parquet(f"{tmp_path}/in")
    model = _Counting()
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    query = stream.train_on_stream(source, lambda batch: batch, model, f"{tmp_path}/ck")
    query.processAllAvailable()
    query.stop()
    assert sum(model.calls) == 20


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 40
    importlib.import_module("bench")


@pytest.mark.parametrize("name", ["asof_ties", "mid_delta_ties", "ofi_ties", "trade_flow_ties", "liquidation_ties", "labels_ties", "feature_matrix_120", "filter_fraction_curve", "max_used_ts", "chunk_assignment"])
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{SMALL}/events.parquet'")
    want = db.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
    assert (a.astype(str) == b.astype(str)).all().all()
