"""Market state over ranges of time: as the state with a task for each chunk, and as SQL."""

import functools

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import queries
from tidemark.plans import specs, state
from tidemark.sources.catalog import Catalog

SMALL = "/root/testdata/sf0.001"
NAMES = ["asof_ties", "mid_smooth_delta_ties", "mid_delta_ties", "ofi_ties", "trade_flow_ties", "liquidation_ties", "liquidation_shifted", "labels_ties", "max_used_ts", "feature_matrix_300"]


def _same(spark, name, query):
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{SMALL}/events.parquet'")
    want = db.execute(entry.oracle_sql()[name]).fetchdf()
    got = query(spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) > 100
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
    assert (a.astype(str) == b.astype(str)).all().all()


@pytest.mark.parametrize("name", NAMES)
def test_queries_with_chunks_cut_into_ranges(spark, monkeypatch, name):
    monkeypatch.setattr(queries, "state_for", functools.partial(specs.state_for, partitions=13))
    run = entry.queries()[name]
    if run.__closure__ and "partitions" in run.__code__.co_freevars:  # these pass their own number on
        real = specs.state_for
        monkeypatch.setattr(queries, "state_for", lambda *a, partitions=None, **b: real(*a, partitions=13, **b))
    _same(spark, name, run)


@pytest.mark.parametrize("name", [n for n in queries.Q if n.endswith("_one_chunk")])
def test_one_chunk_over_many_tasks(spark, name):
    _same(spark, name, entry.queries()[name])


def test_one_chunk_is_many_tasks(spark):
    found = queries.catalog(spark, SMALL, bucketed=True, chunk=queries.ONE_CHUNK)
    assert found.n_chunks == 1
    seen = []
    real = state.written
    state.written = lambda df, spark: seen.append(real(df, spark)) or seen[-1]
    try:
        specs.state_for(found, [specs.Spec("ofi", "order_flow_imbalance", queries.W6)], partitions=8).collect()
    finally:
        state.written = real
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_hard_tables(spark):
    """Empty tables, equal timestamps over many ranges, repeated rows, and quotes only before a range."""
    quotes = spark.createDataFrame([(1, i, 9.0 + i, 1.0 + i, 11.0 + i, 2.0) for i in range(7)], "timestamp long, seq long, bid_price double, bid_amount double, ask_price double, ask_amount double")
    trades = spark.createDataFrame([(5, i, "buy" if i % 3 else "sell", 10.0, 1.0) for i in range(60)] + [(5, 3, "buy", 10.0, 1.0), (0, 99, "buy", 10.0, 1.0), (900, 100, "sell", 10.0, 1.0)], "timestamp long, seq long, side string, price double, amount double")
    feed = trades.where("seq < 9")
    for q in (quotes, quotes.where("false")):
        for t in (trades, trades.where("false")):
            cat = Catalog({"trades": t, "quotes": q, "first_feed": feed}, 1000, "us", lookback={"quotes": 10})
            chunked = {name: cat.chunked(name) for name in cat.tables}
            args = (chunked["trades"], chunked["quotes"], {"first_feed": state.Feed(chunked["first_feed"], 2)}, (3, 4), (2,), (1, 6), (7,))
            a, b = state.market_state(*args), state.carried_state(*args, partitions=9)
            assert set(b.columns) == set(a.columns)
            names = sorted(a.columns)
            # rows that share timestamp and seq have no order of their own, so flows up to the one or the other may change places
            keys = [[str(r) for r in df.select(*names).where("seq <> 3").collect()] for df in (a, b)]
            assert sorted(keys[0]) == sorted(keys[1])
            rest = [sorted(str(r) for r in df.where("seq = 3").select(*(F.col(c) for c in names if not c.startswith("flow"))).collect()) for df in (a, b)]
            assert rest[0] == rest[1]
