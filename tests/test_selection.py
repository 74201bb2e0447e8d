"""The curve by selection: as a full ranking gives it, on ties, NaN and any brackets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation


def frame(spark, rows):
    return spark.createDataFrame(rows, "score double, pnl double, weight double, timestamp long, seq long").repartition(3)


def rows_of(kind, n=700):
    rng = random.Random(kind)
    score = {
        "smooth": lambda i: rng.gauss(0, 1),
        "ties": lambda i: float(rng.randint(0, 3)),
        "hot": lambda i: 1.0 if i % 3 == 0 else rng.random() * 2,
        "nan": lambda i: math.nan if i % 9 == 0 else math.inf if i % 11 == 0 else -math.inf if i % 13 == 0 else rng.random(),
        "zeros": lambda i: 0.0 if i % 2 else -0.0,
    }[kind]
    return [(score(i), float(rng.randint(-8, 8)), float(rng.randint(1, 9)), i // 5, i) for i in range(n)]


@pytest.mark.parametrize("kind", ["smooth", "ties", "hot", "nan", "zeros"])
def test_places_as_the_full_ranking_has_them(spark, kind):
    df = frame(spark, rows_of(kind)).cache()
    full = {r.place: (r.cum_weight, r.cum_pnl) for r in evaluation.worst_first(spark, df).collect()}
    assert sorted(full) == list(range(1, 701))
    places = [0, 1, 7, 70, 71, 350, 699, 700]
    for brackets in ([], [0.0], [0.3, 1.0, 0.31, -5.0], [1.0, 2.0, math.inf], [-0.0, 3.0]):
        got = {r.place: (r.cum_weight, r.cum_pnl) for r in evaluation._at_places(spark, df, places, brackets, 3).collect()}
        assert got == {k: full[k] for k in places if k}
    curve = evaluation.curve(spark, df, 2.0).orderBy("filter_fraction").collect()
    total = full[700]
    for r, f in zip(curve, evaluation.fractions(), strict=True):
        w, p = full.get(int(700 * f), (0.0, 0.0))
        assert r.filtered_turnover_per_day == w / 2 and r.pnl_kept_bps == pytest.approx((total[1] - p) / (total[0] - w))


def test_few_rows_are_ranked(spark, monkeypatch):
    df = spark.range(60_000).select((F.xxhash64("id") / 1e15).alias("score"), F.lit(1.0).alias("pnl"), F.lit(1.0).alias("weight"), F.col("id").alias("timestamp"), F.col("id").alias("seq"))
    seen = []
    real = evaluation.worst_first
    monkeypatch.setattr(evaluation, "worst_first", lambda spark, rows, *a: seen.append(rows.count()) or real(spark, rows, *a))
    evaluation.curve(spark, df, 1.0).collect()
    assert seen[0] < 60_000 * 0.05


def test_small_tables(spark):
    for n in (1, 2, 3, 40):
        rows = rows_of("ties", n)
        got = evaluation.curve(spark, frame(spark, rows), 1.0).orderBy("filter_fraction").collect()
        order = sorted(rows, key=lambda r: (-r[0], -r[3], -r[4]))
        assert [r.filtered_turnover_per_day for r in got] == [sum(r[2] for r in order[: int(n * f)]) for f in evaluation.fractions()]
    with pytest.raises(ValueError):
        evaluation.curve(spark, frame(spark, rows_of("ties", 3)).where("false"), 1.0)
