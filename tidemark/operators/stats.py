"""Statistics of a feature, alone or against a target. Each returns a DataFrame of one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.neighbours import neighbour_information
from tidemark.plans.prefix import running
from tidemark.sources.scratch import written


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy of exact values, in bits; an empty table gives 0."""
    counts = df.groupBy(column).count()
    # sum over values of -p log2 p = log2 n - sum(c log2 c) / n, in one aggregate
    c = F.col("count")
    return counts.agg(F.coalesce(F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c), F.lit(0.0)).alias("entropy"))


def _ranks(spark: SparkSession, df: DataFrame, column: str, name: str) -> DataFrame:
    """value, average rank; the ranking runs over distinct values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    upto = running(spark, counts, [F.col("value")], {"upto": F.col("n")})
    return upto.select(F.col("value").alias(column), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))


def spearman(spark: SparkSession, df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's correlation with average ranks; rows with nulls take no part."""
    both = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # a frequent value meets its rank once for each value beside it, not once a row
    cells = both.groupBy(x, y).agg(F.count("*").alias("n"))
    ranked = cells.join(_ranks(spark, both, x, "rx"), x).join(_ranks(spark, both, y, "ry"), y)
    n, a, b = F.sum("n"), F.col("rx"), F.col("ry")

    def mean(of: Column) -> Column:
        return F.sum(F.col("n") * of) / n

    spread = F.sqrt((mean(a * a) - mean(a) * mean(a)) * (mean(b * b) - mean(b) * mean(b)))
    return ranked.agg(((mean(a * b) - mean(a) * mean(b)) / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def ks(spark: SparkSession, first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic, taken at the last of equal values."""
    one = first.select(F.col(column).alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    both = one.unionByName(second.select(F.col(column).alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("value is not null")
    counts = both.groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = running(spark, counts, [F.col("value")], {"ca": F.col("a"), "cb": F.col("b")})
    n = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    share = upto.crossJoin(F.broadcast(n))  # one row
    return share.agg(F.max(F.abs(F.col("ca") / F.nullif(F.col("na"), F.lit(0)) - F.col("cb") / F.nullif(F.col("nb"), F.lit(0)))).alias("ks"))


def _long(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep``, feature and value (double): a row for each of ``columns`` where it is not null."""
    items = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns))
    return df.select(*keep, F.explode(items).alias("f")).select(*keep, "f.feature", "f.value").where("value is not null")


def _running_by_feature(spark: SparkSession, counts: DataFrame, value: str, sums: list[str]) -> DataFrame:
    """``counts`` (feature, ``value``, numbers to add up) with upto_name: the sum of each of ``sums`` over its feature's values up to this one.

    One running sum over ranges of (feature, value), so that a feature of many values is cut and small ones share a task; what the
    features before have added is taken off.
    """
    upto = running(spark, counts, [F.col("feature"), F.col(value)], {f"upto_{name}": F.col(name) for name in sums})
    base = upto.groupBy("feature").agg(*(F.min(F.col(f"upto_{name}") - F.col(name)).alias(f"base_{name}") for name in sums))
    out = upto.join(base, "feature")
    return out.withColumns({f"upto_{name}": F.col(f"upto_{name}") - F.col(f"base_{name}") for name in sums}).drop(*(f"base_{name}" for name in sums))


def entropies(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, entropy (bits) of each of ``columns``, in one pass; nulls take no part."""
    c = F.col("count")
    counts = _long(df, columns, []).groupBy("feature", "value").count()
    return counts.groupBy("feature").agg((F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)).alias("entropy"))


def spearmans(spark: SparkSession, df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """feature, spearman of each of ``columns`` against ``y``, in one ranking of all; as ``spearman`` of each."""
    rows = _long(df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(columns)), F.col(f"`{y}`").alias("_y")).where("_y is not null"), columns, ["_y"])
    cells = written(rows.groupBy("feature", "value", "_y").agg(F.count("*").alias("n")), spark)
    ranked = cells
    for column, name in (("value", "rx"), ("_y", "ry")):
        upto = _running_by_feature(spark, cells.groupBy("feature", column).agg(F.sum("n").alias("n")), column, ["n"])
        ranked = ranked.join(upto.select("feature", column, (F.col("upto_n") - (F.col("n") - 1) / 2.0).alias(name)), ["feature", column])
    n, a, b = F.sum("n"), F.col("rx"), F.col("ry")

    def mean(of: Column) -> Column:
        return F.sum(F.col("n") * of) / n

    spread = F.sqrt((mean(a * a) - mean(a) * mean(a)) * (mean(b * b) - mean(b) * mean(b)))
    return ranked.groupBy("feature").agg(((mean(a * b) - mean(a) * mean(b)) / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def ks_statistics(spark: SparkSession, first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """feature, ks of each of ``columns`` between the two tables, in one pass; as ``ks`` of each."""
    both = _long(first, columns, []).withColumns({"a": F.lit(1), "b": F.lit(0)}).unionByName(_long(second, columns, []).withColumns({"a": F.lit(0), "b": F.lit(1)}))
    counts = both.groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = written(_running_by_feature(spark, counts, "value", ["a", "b"]), spark)
    total = upto.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.col("upto_a") / F.nullif(F.col("na"), F.lit(0)) - F.col("upto_b") / F.nullif(F.col("nb"), F.lit(0)))
    return upto.join(total, "feature").groupBy("feature").agg(F.max(gap).alias("ks"))


def linear_r2(df: DataFrame, x: str, y: str) -> DataFrame:
    """In-sample R2 of a line."""
    return df.agg(F.regr_r2(F.col(y), F.col(x)).alias("r2"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 16) -> DataFrame:
    """Mutual information in nats of quantile bins of x and y.

    One approximate-quantile pass and a small table; ``neighbours.neighbour_information`` estimates without bins.
    """
    clean = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    shares = [i / bins for i in range(1, bins)]
    edges = clean.select(F.percentile_approx("x", shares, 10_000).alias("ex"), F.percentile_approx("y", shares, 10_000).alias("ey"))
    placed = clean.crossJoin(F.broadcast(edges))  # one row
    cells = placed.select(F.size(F.filter("ex", lambda e: e < F.col("x"))).alias("i"), F.size(F.filter("ey", lambda e: e < F.col("y"))).alias("j"))
    joint = cells.groupBy("i", "j").agg(F.count("*").alias("c"))  # at most bins squared rows
    by_i, by_j, every = (Window.partitionBy(*k) for k in (["i"], ["j"], [F.lit(0)]))
    n = F.sum("c").over(every)
    part = F.col("c") / n * F.log(F.col("c") * n / (F.sum("c").over(by_i) * F.sum("c").over(by_j)))
    return joint.select(part.alias("part")).agg(F.greatest(F.coalesce(F.sum("part"), F.lit(0.0)), F.lit(0.0)).alias("mutual_information"))


def model_r2(df: DataFrame, names: list[str], y: str, estimator) -> DataFrame:
    """In-sample R2 of any regressor of Spark's that takes ``features`` and ``label``."""
    data = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(df.select(*names, F.col(y).cast("double").alias("label")))
    fitted = estimator.fit(data).transform(data)
    r2 = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="r2").evaluate(fitted)
    return df.sparkSession.createDataFrame([(float(r2),)], "r2 double")


def tree_r2(df: DataFrame, names: list[str], y: str) -> DataFrame:
    """In-sample R2 of a random forest: 50 trees of depth 5, seed 42."""
    return model_r2(df, names, y, RandomForestRegressor(numTrees=50, maxDepth=5, seed=42))


ANALYZERS: dict[str, Callable[..., DataFrame]] = {
    "entropy": entropy,
    "spearman": spearman,
    "ks": ks,
    "linear_r2": linear_r2,
    "mutual_information": neighbour_information,
    "mutual_information_bins": mutual_information,
    "tree_r2": tree_r2,
}
