"""The batch runs end to end on derived tables."""

from tidemark import jobs
from tidemark.functions.exprs import SECOND
from tidemark.plans.specs import market_catalog, state_for
from tidemark.queries import SCALE, tables
from tidemark.sources import sinks


def test_train_then_infer(spark, tmp_path, monkeypatch):
    found = tables(spark, "/root/testdata/sf0.001")
    start = found["trades"].agg({"timestamp": "min"}).first()[0]
    day = 86_400 * SECOND
    # chunks longer than the period, since look-back is in seconds and these tables are sparse
    options = dict(chunk_sec=40 * 86_400, scale=SCALE, least_turnover=1.0)
    states = []
    monkeypatch.setattr(jobs, "state_for", lambda *a, **b: states.append(1) or state_for(*a, **b))
    best = jobs.train(spark, found, f"{tmp_path}/a", (start, start + 15 * day), (start + 15 * day, start + 25 * day), [30, 120], trees_per_call=2, max_depth=2, **options)
    assert best.count() > 0 and {r.horizon_sec for r in best.collect()} == {30, 120}
    assert len(states) == 2  # one for each period, whatever the number of horizons and chunks
    about = sinks.read_json(spark, f"{tmp_path}/a/metadata/core_30s")
    assert about["chunks"] == 1 and len(about["features"]) == 36 and about["best"]["experiment"] == "core"
    assert sinks.read_json(spark, f"{tmp_path}/a/metadata/core_120s")["params"] == jobs.PARAMS | {"trees_per_call": 2, "max_depth": 2}
    again = jobs.infer(spark, found, f"{tmp_path}/a/models", f"{tmp_path}/b", (start + 15 * day, start + 25 * day), **options)
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in best.collect()]


def test_stored_state_gives_the_same_rows(spark):
    found = tables(spark, "/root/testdata/sf0.001")
    day = 86_400
    catalog = market_catalog(found, 5 * day)
    state = jobs.stored_state(spark, catalog, [30, 300], SCALE)
    plain, stored = (jobs.horizon_pipeline(None, catalog, 300, SCALE, s) for s in (None, state))
    for chunk in (1, None):
        a, b = (sorted(map(str, p.rows(chunk).collect())) for p in (plain, stored))
        assert a == b and len(a) > 10
    assert "PartitionFilters: [isnotnull(chunk_id" in stored.rows(1)._jdf.queryExecution().toString()
