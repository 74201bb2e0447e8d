"""Running sums over a whole table in a given order, without one task that holds all rows.

Rows are range-partitioned by the order and written with their partition's number. Sums within each
partition come from a window, the sums of all earlier partitions (one row per partition) are added.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def running(spark: SparkSession, df: DataFrame, order: list[Column], sums: Mapping[str, Column], partitions: int | None = None) -> DataFrame:
    """``df`` with each name of ``sums``: the sum over this row and all before it. ``order`` should be total."""
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"_v_{name}": value for name, value in sums.items()}).repartitionByRange(n, *order)
    kept = written(dealt.withColumn("_part", F.spark_partition_id()), spark)
    totals = kept.groupBy("_part").agg(*(F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = kept.withColumns({f"_c_{name}": F.sum(f"_v_{name}").over(inside) for name in sums})
    out = local.join(F.broadcast(offsets), "_part")  # at most n rows
    return out.select(*df.columns, *((F.col(f"_c_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums))
