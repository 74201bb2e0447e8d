"""Bounds of sources from the footers of their files."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.specs import market_catalog
from tidemark.sources import catalog
from tidemark.sources.catalog import Catalog, Source, bounds_by_source, footer_bounds, known_bounds


def _sources(spark, folder, **options):
    for i, name in enumerate(("trades", "quotes")):
        spark.range(100 * i, 100 * i + 1000, numPartitions=3).selectExpr("id * 7 as timestamp", "'buy' as side").write.options(**options).parquet(f"{folder}/{name}")
    spark.range(0).selectExpr("id as timestamp").write.parquet(f"{folder}/none")
    return [Source(name, f"{folder}/{name}") for name in ("trades", "quotes", "none")]


def test_no_data_is_read(spark, tmp_path):
    named = _sources(spark, tmp_path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    found = footer_bounds(spark, named)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [MIN(timestamp), MAX(timestamp)]") == 3
    want = {"trades": (0, 6993), "quotes": (700, 7693), "none": (None, None)}
    assert known_bounds(found) == want == known_bounds(bounds_by_source({s.name: s.read(spark) for s in named}))
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before and spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    with pytest.raises(ValueError):
        footer_bounds(spark, [])


def test_catalogs_take_them(spark, tmp_path, monkeypatch):
    named = _sources(spark, tmp_path)
    tables = {s.name: s.read(spark) for s in named}
    plain = Catalog(tables, 500, "us")
    monkeypatch.setattr(catalog, "bounds_by_source", lambda tables: pytest.fail("the rows were read"))
    found = Catalog.of(spark, named, window=500, timescale="us")
    assert (found.start, found.end, found.n_chunks) == (plain.start, plain.end, plain.n_chunks) == (0, 7694, 16)
    assert market_catalog(tables, 1, 100, 5000, found.bounds).start == 100


def test_files_without_statistics(spark, tmp_path):
    db = duckdb.connect()
    named = _sources(spark, tmp_path)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.column.statistics.enabled", "false")
    try:
        spark.range(50).selectExpr("id as timestamp").write.parquet(f"{tmp_path}/plain")
    finally:
        hadoop.unset("parquet.column.statistics.enabled")
    assert Catalog.of(spark, [*named, Source("plain", f"{tmp_path}/plain")], window=500, timescale="us").end == 7694
    with pytest.raises(Exception, match="."):
        Catalog.of(spark, [Source("nowhere", f"{tmp_path}/nowhere")])
    small = "/root/testdata/sf0.001"
    for name in ("events", "orders", "lineitem"):
        db.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["footer_bounds"](spark, small).collect())
    assert got == sorted(db.execute(entry.oracle_sql()["footer_bounds"]).fetchall())
