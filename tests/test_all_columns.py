"""Statistics of many columns at once: as of each by itself, and as SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import stats

SMALL = "/root/testdata/sf0.001"


def test_as_each_column_by_itself(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 101).cast("double").alias("a"),
        (F.col("id") * F.col("id") % 13).cast("double").alias("b.b"),
        F.lit(1.0).alias("c"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 11 % 29).cast("double").alias("y"),
    ).cache()
    names = ["a", "b.b", "c"]
    plain = df.withColumnRenamed("b.b", "b")
    one = {n: n.replace("b.b", "b") for n in names}
    got = {r.feature: r.entropy for r in stats.entropies(df, names).collect()}
    assert got == pytest.approx({n: stats.entropy(plain.where(f"{one[n]} is not null"), one[n]).first()[0] for n in names})
    got = {r.feature: r.spearman for r in stats.spearmans(spark, df, names, "y").collect()}
    want = {n: stats.spearman(spark, plain, one[n], "y").first()[0] for n in names}
    assert got.pop("c") is None and want.pop("c") is None and got == pytest.approx(want)
    got = {r.feature: r.ks for r in stats.ks_statistics(spark, df.where("y < 10"), df.where("y >= 10"), names).collect()}
    assert got == pytest.approx({n: stats.ks(spark, plain.where("y < 10"), plain.where("y >= 10"), one[n]).first()[0] for n in names})
    assert stats.entropies(df.where("false"), names).count() == 0 and stats.spearmans(spark, df.where("false"), names, "y").count() == 0


@pytest.mark.parametrize("name", ["entropies", "spearmans", "ks_statistics"])
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{SMALL}/events.parquet'")
    want = sorted(map(str, db.execute(entry.oracle_sql()[name]).fetchall()))
    got = entry.queries()[name](spark, SMALL)
    columns = [d[0] for d in db.execute(entry.oracle_sql()[name]).description]
    assert got.columns == columns and sorted(str(tuple(r)) for r in got.collect()) == want and len(want) == 36
