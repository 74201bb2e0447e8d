"""Connected components of an edge table, by rounds of distributed label passing.

Each round gives every node the smallest label among itself, its neighbours and its label's own
label (pointer jumping), so a chain of length n takes about log n rounds. Labels are written to
the shared folder after each round, which cuts the lineage. The driver only sees a count of
changes. A hub's edges meet its label in a join of two written tables, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (a, b); self loops and repeats are fine.

    Alternates large stars (join each larger neighbour to the least neighbour) and small stars (join
    each smaller neighbour to it), so a hub's edges spread and the edges end as one star per component.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").distinct(), spark)
    while True:
        # large star: every neighbour above u is joined to the least of u's neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), spark)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every neighbour at or below u, and u itself, is joined to the least
        down = written(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), spark)
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), spark)
        joined = down.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        after = written(small, spark)
        ups = after.groupBy("a").agg(F.count("*").alias("n"))
        tops = after.select(F.col("b").alias("a")).distinct()
        # done when every node has one edge and no target has an edge of its own: stars only
        unsettled = ups.where("n > 1").select("a").union(tops.join(ups, "a", "left_semi"))
        now = after
        if unsettled.isEmpty():
            break
    kind = dict(now.dtypes)["a"]
    tops = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops).select(F.col("node").cast(kind), F.col("component").cast(kind))
