"""The two batch runs: train a model per horizon and judge it, and judge saved models over another period."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND, sample_weight
from tidemark.operators import evaluation, labels, training
from tidemark.operators.boosting import HistogramBooster
from tidemark.plans.specs import EXPERIMENTS, HORIZONS_SEC, feature_specs, market_catalog, state_for
from tidemark.sources import sinks
from tidemark.sources.catalog import Catalog, bounds_by_source, known_bounds
from tidemark.sources.scratch import written


# What a model gets from each chunk.
PARAMS = {"trees_per_call": 300, "max_depth": 5, "learning_rate": 0.01}


def stored_state(spark: SparkSession, catalog: Catalog, horizons_sec: Iterable[int], scale: int = SECOND, partitions: int | None = None) -> DataFrame:
    """The market state of all chunks with the windows of all horizons, written once, a partition for each chunk."""
    horizons = sorted(set(horizons_sec))
    specs = [spec for horizon in horizons for spec in feature_specs(horizon, scale)]
    return written(state_for(catalog, specs, tuple(h * scale for h in horizons), partitions=partitions), spark, by="chunk_id")


def horizon_pipeline(model, catalog: Catalog, horizon_sec: int, scale: int = SECOND, state: DataFrame | None = None) -> training.ModelPipeline:
    """The 36 features of a horizon against its badness, weighted by capped notional; out of a stored ``state`` if there is one."""
    h = horizon_sec * scale
    return training.ModelPipeline(
        model,
        feature_specs(horizon_sec, scale),
        catalog,
        labels.target(h),
        sample_weight(F.col("price"), F.col("amount")),
        lambda state: labels.with_pnl(state, [h]),
        (h,),
        state,
    )


def evaluate(spark: SparkSession, pipeline: training.ModelPipeline, horizon_sec: int, experiment: str = EXPERIMENTS[0], scale: int = SECOND) -> DataFrame:
    """The filter curve of a pipeline's model over its catalog's whole period."""
    h, catalog = horizon_sec * scale, pipeline.catalog
    predictions = pipeline.predictions(F.col(f"pnl_{h}"), F.col(f"valid_{h}"))
    return evaluation.evaluate_predictions(spark, predictions, evaluation.evaluation_days(catalog.start, catalog.end), experiment, horizon_sec)


def _curves(spark: SparkSession, out: str, names: list[str], least: float) -> DataFrame:
    curves = [spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/curves/{name}") for name in names]
    best = evaluation.summary(curves, least)
    sinks.write_csv(best, f"{out}/summary")
    return best


def train(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    out: str,
    train_period: tuple[int, int],
    validation_period: tuple[int, int],
    horizons_sec: Iterable[int] = HORIZONS_SEC,
    chunk_sec: float = 3600,
    scale: int = SECOND,
    least_turnover: float = evaluation.MIN_TURNOVER_PER_DAY,
    bounds: Mapping[str, tuple[int | None, int | None]] | None = None,
    partitions: int | None = None,
    **params,
) -> DataFrame:
    """Per horizon: models/, curves/ and importances/ below ``out``, and metadata/ with the best row; returns the summary.

    Periods are microseconds, end exclusive. ``scale`` is the length of a window's second. The market state of a period is
    computed once for all horizons, over ``partitions`` tasks if given, or one for each chunk. ``bounds`` are the tables' (see
    ``footer_bounds``), if known. ``params`` are those of the model, in place of ``PARAMS``.
    """
    names, horizons, params = [], list(horizons_sec), PARAMS | params
    bounds = known_bounds(bounds_by_source(tables)) if bounds is None else bounds
    catalogs = [market_catalog(tables, chunk_sec, *period, bounds) for period in (train_period, validation_period)]
    states = [stored_state(spark, catalog, horizons, scale, partitions) for catalog in catalogs]
    for horizon in horizons:
        name = f"{EXPERIMENTS[0]}_{horizon}s"
        columns = [s.name for s in feature_specs(horizon, scale)]
        model = training.build_model("residual_boosting", "regression", columns, **params)
        trained = horizon_pipeline(model, catalogs[0], horizon, scale, states[0]).fit()
        judged = horizon_pipeline(model, catalogs[1], horizon, scale, states[1])
        sinks.write_csv(evaluate(spark, judged, horizon, scale=scale), f"{out}/curves/{name}")
        model.save(spark, f"{out}/models/{name}")
        sinks.write_csv(model.importances(spark), f"{out}/importances/{name}")
        best = evaluation.best_row(spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/curves/{name}"), least_turnover).first()
        about = {"experiment": EXPERIMENTS[0], "horizon_sec": horizon, "features": columns, "params": params, "chunks": trained, "train": train_period, "validation": validation_period, "best": best.asDict() if best else None}
        sinks.write_json(spark, about, f"{out}/metadata/{name}")
        names.append(name)
    return _curves(spark, out, names, least_turnover)


def infer(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    models: str,
    out: str,
    period: tuple[int, int],
    chunk_sec: float = 3600,
    scale: int = SECOND,
    least_turnover: float = evaluation.MIN_TURNOVER_PER_DAY,
) -> DataFrame:
    """Curves of all models below ``models`` over ``period``, and their summary, which is returned; no models raise ValueError."""
    names = [n for n in sinks.file_names(spark, models) if not n.startswith((".", "_"))]
    if not names:
        raise ValueError(f"no models in {models}")
    parts = [training.model_file_parts(name) for name in names]
    catalog = market_catalog(tables, chunk_sec, *period)
    state = stored_state(spark, catalog, [horizon for _, horizon in parts], scale)
    for name, (experiment, horizon) in zip(names, parts, strict=True):
        model = HistogramBooster.load(spark, f"{models}/{name}")
        pipeline = horizon_pipeline(model, catalog, horizon, scale, state)
        sinks.write_csv(evaluate(spark, pipeline, horizon, experiment, scale), f"{out}/curves/{name}")
    return _curves(spark, out, names, least_turnover)
