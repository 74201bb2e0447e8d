"""Checks of feature tables before they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, NAN, INF, FORWARD, MISALIGNED = "OK", "HAS_NANS", "HAS_INFS", "FORWARD_LOOKING", "MISALIGNED"


def report(features: DataFrame, names: list[str], feature_ts: str | None = None) -> DataFrame:
    """feature, status: the first failing of NaN (or null), infinity, forward-looking, misaligned; one aggregate over all rows.

    A value looks forward if ``mu_<name>`` is after ``timestamp``; it is misaligned if ``feature_ts`` is not ``timestamp``.
    """
    aggs: list[Column] = []
    for name in names:
        x = F.col(name).cast("double")
        aggs += [
            F.max(x.isNull() | F.isnan(x)).alias(f"nan_{name}"),
            F.max(F.abs(x) == float("inf")).alias(f"inf_{name}"),
            (F.max(F.col(f"mu_{name}") > F.col("timestamp")) if f"mu_{name}" in features.columns else F.lit(False)).alias(f"fwd_{name}"),
            (F.max(~F.col(feature_ts).eqNullSafe(F.col("timestamp"))) if feature_ts else F.lit(False)).alias(f"mis_{name}"),
        ]
    one = features.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("feature"),
            F.when(F.col(f"nan_{name}"), NAN).when(F.col(f"inf_{name}"), INF).when(F.col(f"fwd_{name}"), FORWARD).when(F.col(f"mis_{name}"), MISALIGNED).otherwise(OK).alias("status"),
        )
        for name in names
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def require(features: DataFrame, names: list[str]) -> None:
    """Raises ValueError with the first feature that fails."""
    bad = report(features, names).where(F.col("status") != OK).first()
    if bad is not None:
        raise ValueError(f"{bad.feature}: {bad.status}")


def guarded(features: DataFrame, names: list[str]) -> DataFrame:
    """The same rows; reading one that fails raises at run time, without a job of its own."""
    out = features
    for name in names:
        x = F.col(name).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        if f"mu_{name}" in features.columns:
            bad = bad | (F.col(f"mu_{name}") > F.col("timestamp"))
        out = out.withColumn(name, F.when(bad, F.raise_error(F.lit(f"{name} fails validation")).cast(features.schema[name].dataType)).otherwise(F.col(name)))
    return out
