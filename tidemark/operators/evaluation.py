"""How much better trades get when the worst-scored share of them is filtered out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND
from tidemark.plans.prefix import running
from tidemark.sources.scratch import written

MAX_FRACTION = 0.30
MIN_TURNOVER_PER_DAY = 500_000.0
DAY_US = 86_400 * SECOND


def evaluation_days(start_us: int, end_us: int) -> float:
    return max(1.0, (end_us - start_us) / DAY_US)


def fractions(max_fraction: float = MAX_FRACTION) -> list[float]:
    """Evenly spaced shares from 0 to ``max_fraction``, one per percent."""
    steps = max(1, round(max_fraction * 100))
    width = max_fraction / steps
    return [i * width for i in range(steps)] + [max_fraction]


def eligible(predictions: DataFrame) -> DataFrame:
    """The rows with valid labels; ValueError if there are none."""
    out = predictions.where("valid")
    if out.isEmpty():
        raise ValueError("no valid rows")
    return out


def worst_first(spark: SparkSession, predictions: DataFrame, partitions: int | None = None) -> DataFrame:
    """``predictions`` with place (1 is the worst), cum_weight and cum_pnl; by score descending (NaN first), later rows first among equals."""
    order = [F.col("score").desc(), F.col("timestamp").desc(), F.col("seq").desc()]
    pnl = (F.col("pnl") * F.col("weight")).cast("double")
    return running(spark, predictions, order, {"place": F.lit(1), "cum_weight": F.col("weight").cast("double"), "cum_pnl": pnl}, partitions)


def _error_columns() -> list[Column]:
    w, off = F.col("weight"), F.col("score") + F.col("pnl")
    total = F.sum(w.cast("double"))
    return [
        F.when(total > 0, F.sqrt(F.sum((w * off * off).cast("double")) / F.nullif(total, F.lit(0.0)))).alias("weighted_rmse"),
        F.when(total > 0, F.sum((w * F.abs(off)).cast("double")) / F.nullif(total, F.lit(0.0))).alias("weighted_mae"),
    ]


def weighted_errors(predictions: DataFrame) -> DataFrame:
    """weighted_rmse, weighted_mae of the score against badness (-pnl); null without weight."""
    return predictions.agg(*_error_columns())


ACCURACY = 10_000


def _at_places(spark: SparkSession, rows: DataFrame, places: list[int], brackets: list[float], partitions: int | None) -> DataFrame:
    """place, cum_weight, cum_pnl (as of ``worst_first``) of the rows of ``rows`` at some ``places``, without ranking the others.

    ``brackets`` are scores, close above and below those at the places for the fewest rows to be ranked; any others give the same
    result. They cut the scores into points and the gaps between them. Counts and sums of each tell where the places lie, and only
    points and gaps with a place are ranked, on top of what lies above them.
    """
    score = F.when(F.isnan("score"), float("inf")).otherwise(F.col("score").cast("double"))
    ends = sorted({0.0 if e == 0 else e for e in brackets})
    # 2 i: the gap below the i-th end, 2 i + 1: the end itself
    below = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < score)) if ends else F.lit(0)
    region = 2 * below + (F.array_contains(F.array(*map(F.lit, ends)), score).cast("int") if ends else F.lit(0))
    rows = rows.withColumn("region", region)
    weight, pnl = F.col("weight").cast("double"), (F.col("pnl") * F.col("weight")).cast("double")
    sums = rows.groupBy("region").agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(pnl).alias("p")).collect()  # at most 2 * ends + 1 rows
    asked, above = sorted(places), 0
    met: list[tuple[int, int, float, float]] = []  # region, and what the regions above it that are not ranked add
    left = [0, 0.0, 0.0]
    for r in sorted(sums, key=lambda r: -r.region):
        if any(above < k <= above + r.n for k in asked):
            met.append((r.region, *left))
        else:
            left = [left[0] + r.n, left[1] + (r.w or 0.0), left[2] + (r.p or 0.0)]
        above += r.n
    if not met:
        return spark.createDataFrame([], "place long, cum_weight double, cum_pnl double")
    add = F.broadcast(spark.createDataFrame(met, "region int, add_n long, add_w double, add_p double"))  # at most a row for each place
    ranked = worst_first(spark, rows.where(F.col("region").isin([m[0] for m in met])), partitions).join(add, "region")
    ranked = ranked.select((F.col("place") + F.col("add_n")).alias("place"), (F.col("cum_weight") + F.col("add_w")).alias("cum_weight"), (F.col("cum_pnl") + F.col("add_p")).alias("cum_pnl"))
    return ranked.where(F.col("place").isin(asked))


def curve(
    spark: SparkSession,
    predictions: DataFrame,
    days: float,
    experiment: str = "core",
    horizon_sec: int = 0,
    max_fraction: float = MAX_FRACTION,
    partitions: int | None = None,
) -> DataFrame:
    """One row per share: what is kept and filtered when the int(n * share) worst rows go; ValueError without rows.

    ``predictions``: score, pnl, weight, timestamp, seq of valid rows, which are written once to the shared folder. One pass gives totals, errors and
    approximate quantiles close to each cut, a second one what lies between these; only the rows close to a cut, and those that share
    its score, are ranked.
    """
    held = written(predictions.select("score", "pnl", "weight", "timestamp", "seq"), spark)
    pnl = (F.col("pnl") * F.col("weight")).cast("double")
    near = sorted({min(1.0, max(0.0, 1 - f + side * 3 / ACCURACY)) for f in fractions(max_fraction)[1:] for side in (-1, 1)})
    quantiles = F.percentile_approx(F.when(~F.isnan("score"), F.col("score").cast("double")), near, ACCURACY).alias("near")
    total = held.agg(F.count("*").alias("n"), F.sum(F.col("weight").cast("double")).alias("w"), F.sum(pnl).alias("p"), quantiles, *_error_columns()).first()
    if not total.n:
        raise ValueError("no valid rows")
    cuts = [(f, int(total.n * f)) for f in fractions(max_fraction)]
    points = spark.createDataFrame(cuts, "filter_fraction double, place long")
    ranked = _at_places(spark, held, sorted({k for _, k in cuts}), total.near or [], partitions)
    at = F.broadcast(points).join(ranked, "place", "left")
    w, p = F.lit(total.w).cast("double"), F.lit(total.p).cast("double")
    cw, cp = (F.coalesce(c, F.lit(0.0)) for c in ("cum_weight", "cum_pnl"))

    def mean(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / F.nullif(den, F.lit(0.0)))

    kept = mean(p - cp, w - cw)
    return at.select(
        F.lit(experiment).alias("experiment"),
        F.lit(horizon_sec).alias("horizon_sec"),
        "filter_fraction",
        (kept - mean(p, w)).alias("score_bps"),
        mean(p, w).alias("pnl_all_bps"),
        kept.alias("pnl_kept_bps"),
        mean(cp, cw).alias("pnl_filtered_bps"),
        (cw / days).alias("filtered_turnover_per_day"),
        ((w - cw) / days).alias("kept_turnover_per_day"),
        F.lit(total.weighted_rmse).cast("double").alias("weighted_rmse_badness_bps"),
        F.lit(total.weighted_mae).cast("double").alias("weighted_mae_badness_bps"),
    )


def evaluate_predictions(spark: SparkSession, predictions: DataFrame, days: float, experiment: str = "core", horizon_sec: int = 0, max_fraction: float = MAX_FRACTION) -> DataFrame:
    """The curve over the rows with valid labels; ValueError if there are none."""
    return curve(spark, predictions.where("valid"), days, experiment, horizon_sec, max_fraction)


def enough_turnover(curves: DataFrame, least: float = MIN_TURNOVER_PER_DAY) -> DataFrame:
    return curves.where(F.col("kept_turnover_per_day") >= least)


def best_row(curves: DataFrame, least: float = MIN_TURNOVER_PER_DAY) -> DataFrame:
    """The row with the highest score among those with enough turnover; ties to the smaller share."""
    return enough_turnover(curves, least).orderBy(F.col("score_bps").desc_nulls_last(), "filter_fraction").limit(1)


def summary(curves: list[DataFrame], least: float = MIN_TURNOVER_PER_DAY) -> DataFrame:
    """All curves' rows with enough turnover, by horizon, then best score first."""
    out = curves[0]
    for one in curves[1:]:
        out = out.unionByName(one)
    return enough_turnover(out, least).orderBy("horizon_sec", F.col("score_bps").desc_nulls_last(), "filter_fraction")
