"""Golden values of every feature, with ties, and a property test of the state against searchsorted."""

import math

import numpy as np
import pytest

from tidemark.functions.exprs import SECOND
from tidemark.operators import labels
from tidemark.operators.features import FEATURES, FEED, Spec
from tidemark.plans.specs import feature_specs, feature_table
from tidemark.plans.state import Feed, market_state

W = 5 * SECOND


def _frame(spark, rows, schema):
    rows = [(0, int(r[0] * SECOND), i, *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, f"chunk_id long, timestamp long, seq long, {schema}")


def _trades(spark, rows):
    return _frame(spark, [(t, s, float(p), float(a)) for t, p, a, s in rows], "side string, price double, amount double")


def _quotes(spark, rows):
    return _frame(spark, [tuple(map(float, r)) for r in rows], "bid_price double, bid_amount double, ask_price double, ask_amount double")


@pytest.fixture(scope="module")
def golden(spark):
    quotes = _quotes(spark, [(1, 99, 2, 101, 1), (3, 99, 3, 101, 2), (3, 100, 1, 102, 2), (6, 100, 4, 101, 2), (10, 98, 5, 100, 1), (12, 99, 2, 101, 3)])
    trades = _trades(spark, [(0, 100, 1, "buy"), (3, 101, 2, "buy"), (6, 100, 1, "sell"), (6, 101, 3, "buy"), (12, 99, 2000, "sell")])
    feed = _trades(spark, [(2, 100, 5, "buy"), (6, 101, 2, "sell"), (7, 99, 4, "sell"), (11, 100, 1, "buy")])
    return market_state(trades, quotes, {"f": Feed(feed), "g": Feed(feed, 200_000)}, [W], [W], [W], [2 * SECOND, 4 * SECOND, 8 * SECOND]).cache()


EXPECTED = {
    "spread_bps": [0, 198.020, 99.5025, 99.5025, 200],
    "volume_imbalance": [0, -0.333333, 0.333333, 0.333333, -0.2],
    "volume_imbalance_abs": [0, 0.333333, 0.333333, 0.333333, 0.2],
    "side_volume_imbalance": [0, -0.333333, -0.333333, 0.333333, 0.2],
    "mid_smooth_delta_bps": [0, 66.4452, 12.4533, 12.4533, 50.2513],
    "side_mid_smooth_delta_bps": [0, 66.4452, -12.4533, 12.4533, -50.2513],
    "top_depth_log": [0, 5.72031, 6.40192, 6.40192, 6.21860],
    "mid_delta_bps": [0, 0, 0, 0, -49.7512],
    "side_mid_delta_bps": [0, 0, 0, 0, 49.7512],
    "micro_price_premium_bps": [0, -33.0033, 16.5837, 16.5837, -20],
    "side_micro_price_premium_bps": [0, -33.0033, -16.5837, 16.5837, 20],
    "edge_bps": [0, 0, 50, 49.5050, 101.010],
    "order_flow_imbalance": [0, 4, 5, 5, -2],
    "side_order_flow_imbalance": [0, 4, -5, 5, 2],
    "order_flow_imbalance_norm": [0, 1.33333, 0.833333, 0.833333, -0.4],
    "depth_imbalance_value": [0, -0.342105, 0.328904, 0.328904, -0.209581],
    "trade_side": [1, 1, -1, 1, -1],
    "trade_notional_log": [4.61512, 5.31321, 4.61512, 5.71703, 12.1960],
    "trade_signed_notional_log": [4.61512, 5.31321, -4.61512, 5.71703, -12.1960],
    "flow_imbalance": [1, 1, 0.337748, 0.669421, -1],
    "side_flow_imbalance": [1, 1, -0.337748, 0.669421, 1],
    "flow_toxicity": [1, 1, 0.337748, 0.669421, 1],
    "flow_notional_log": [4.61512, 5.71373, 5.71373, 6.40688, 12.1960],
    "flow_count_log": [0.693147, 1.09861, 1.09861, 1.38629, 0.693147],
    "feed_imbalance": [0, 1, 0.424501, 0.424501, -0.596774],
    "feed_strength": [0, 6.21661, 5.70044, 5.70044, -5.69373],
    "feed_total_notional_log": [0, 6.21661, 6.55536, 6.55536, 6.20859],
    "feed_count_log": [0, 0.693147, 1.09861, 1.09861, 1.09861],
    "feed_mean_notional_log": [0, 6.21661, 5.86363, 5.86363, 5.51745],
    "side_feed_imbalance": [0, 1, -0.424501, 0.424501, 0.596774],
    "side_feed_strength": [0, 6.21661, -5.70044, 5.70044, 5.69373],
}


def test_every_feature_has_golden_values():
    assert set(EXPECTED) == set(FEATURES)


def test_golden_features(golden):
    specs = [Spec(name, name, W, "f" if FEATURES[name].source == FEED else None) for name in EXPECTED]
    rows = feature_table(golden, specs).orderBy("seq").collect()
    for name, want in EXPECTED.items():
        assert [r[name] for r in rows] == pytest.approx(want, rel=1e-5, abs=1e-6), name


def test_shifted_feed(golden):
    specs = [Spec("a", "feed_imbalance", W, "g"), Spec("b", "feed_strength", W, "g")]
    rows = feature_table(golden, specs).orderBy("seq").collect()
    assert [r.a for r in rows] == pytest.approx([0, 1, 1, 1, -0.596774], rel=1e-5)
    assert [r.b for r in rows] == pytest.approx([0, 6.21661, 6.21661, 6.21661, -5.69373], rel=1e-5)


def test_max_used(golden):
    specs = [Spec("a", "spread_bps"), Spec("b", "order_flow_imbalance", W)]
    rows = feature_table(golden, specs, max_used=True).orderBy("seq").collect()
    assert [r.mu_a / SECOND for r in rows] == [0, 3, 6, 6, 12]
    assert [r.mu_b / SECOND for r in rows] == [0, 3, 6, 6, 12]


def test_golden_labels(golden):
    hs = [2 * SECOND, 4 * SECOND, 8 * SECOND]
    rows = labels.with_pnl(golden, hs).orderBy("seq").collect()
    want = [[0.5, -99.5, -49.5], [0.5, 50.0049505, 198.51980198], [50.5, -99.5, None], [50.0049505, 198.51980198, None], [None] * 3]
    for row, values in zip(rows, want, strict=True):
        for h, v in zip(hs, values, strict=True):
            assert row[f"pnl_{h}"] is None if v is None else row[f"pnl_{h}"] == pytest.approx(v)
            assert row[f"valid_{h}"] == (v is not None)


# The inputs and results of the two label tests below must match.


def test_pinned_labels(spark):
    trades = _trades(spark, [(0, 100, 1, "buy"), (30, 100, 2, "buy"), (60, 100, 1, "sell"), (120, 100, 1, "sell"), (300, 100, 1, "buy")])
    bid = [9, 14, 24, 99, 99, 200, 85, 145]
    ask = [11, 16, 26, 101, 101, 200, 115, 155]
    quotes = _quotes(spark, [(t, b, 1, a, 1) for t, b, a in zip([30, 60, 90, 150, 210, 300, 420, 600], bid, ask, strict=True)])
    hs = [30 * SECOND, 120 * SECOND, 300 * SECOND]
    df = labels.with_pnl(market_state(trades, quotes, horizons=hs), hs)
    rows = df.orderBy("seq").collect()
    got = [[r[f"pnl_{h}"] for h in hs] for r in rows]
    want = [[9000.5, 7500.5, -9999.5], [8500.5, 0.5, -9999.5], [-7499.5, 0.5, 10000.5], [0.5, 0.5, 0.5], [-9999.5, 0.5, -4999.5]]
    np.testing.assert_allclose(got, want)
    mean = {r.horizon: r for r in labels.averages(df, hs).collect()}
    assert [mean[h].pnl_all for h in hs] == pytest.approx([1417.16666667, 1250.5, -4166.16666667])
    assert [mean[h].pnl_kept for h in hs] == pytest.approx([mean[h].pnl_all for h in hs])
    assert all(mean[h].pnl_filtered is None and mean[h].score == 0 for h in hs)


def test_pinned_label_validity(spark):
    trades = _trades(spark, [(0, 100, 1, "buy"), (1, 100, 2, "buy"), (50, 100, 1, "sell"), (200, 100, 1, "sell"), (300, 100, 1, "buy")])
    quotes = _quotes(spark, [(t, b, 1, a, 1) for t, b, a in zip([30, 60, 90, 150, 210, 310], [9, 14, 24, 99, 99, 200], [11, 16, 26, 101, 101, 200], strict=True)])
    hs = [30 * SECOND, 120 * SECOND, 300 * SECOND]
    df = labels.with_pnl(market_state(trades, quotes, horizons=hs), hs)
    got = [[r[f"pnl_{h}"] for h in hs] for r in df.orderBy("seq").collect()]
    want = [[9000.5, 7500.5, 0.5], [9000.5, 7500.5, 0.5], [-8499.5, 0.5, None], [0.5, None, None], [None] * 3]
    assert [[v is None for v in r] for r in got] == [[v is None for v in r] for r in want]
    np.testing.assert_allclose(np.array(got, float), np.array(want, float), equal_nan=True)
    assert [r.pnl_all for r in labels.averages(df, hs).orderBy("horizon").collect()] == pytest.approx([3700.5, 5625.5, 0.5])


def test_left_bound_is_closed(spark):
    trades = _trades(spark, [(2, 100, 1, "buy")])
    feed = _trades(spark, [(1, 100, 1, "buy")])
    state = market_state(trades, None, {"f": Feed(feed)}, feed_windows=[SECOND])
    assert feature_table(state, [Spec("x", "feed_imbalance", SECOND, "f")]).first().x == 1.0


def test_bad_side_raises(spark):
    trades = _trades(spark, [(2, 100, 1, "hold")])
    with pytest.raises(Exception, match="side must be"):
        feature_table(market_state(trades), [Spec("x", "trade_side")]).collect()


def test_no_quotes_gives_zero_and_invalid(spark):
    trades = _trades(spark, [(2, 100, 1, "buy")])
    state = market_state(trades, _quotes(spark, []), quote_windows=[W], horizons=[W])
    row = labels.with_pnl(feature_state := state, [W]).first()
    assert row[f"pnl_{W}"] is None and not row[f"valid_{W}"]
    assert feature_table(feature_state, [Spec("x", "spread_bps"), Spec("y", "order_flow_imbalance_norm", W)]).first()[2:] == (0.0, 0.0)


@pytest.mark.parametrize("seed", [0, 1])
def test_state_against_searchsorted(spark, seed):
    rng = np.random.default_rng(seed)
    q = np.sort(rng.integers(0, 60, 150))
    t = np.sort(rng.integers(0, 60, 100))
    bid = rng.integers(90, 95, 150).astype(float)
    ba, aa = rng.integers(1, 9, (2, 150)).astype(float)
    side = rng.choice(["buy", "sell"], 100)
    amount = rng.integers(1, 5, 100).astype(float)
    quotes = _quotes(spark, list(zip(q, bid, ba, bid + 1, aa, strict=True)))
    trades = _trades(spark, list(zip(t.tolist(), [100] * 100, amount.tolist(), side.tolist(), strict=True)))
    w = 7
    rows = market_state(trades, quotes, None, [w * SECOND], (), [w * SECOND], [3 * SECOND]).orderBy("seq").collect()
    left, right = np.searchsorted(q, t - w, "left"), np.searchsorted(q, t, "right")
    mid = np.concatenate([[0], np.cumsum(bid + 0.5)])
    for i, r in enumerate(rows):
        assert r[f"q_n_{w * SECOND}"] == right[i] - left[i]
        assert r[f"q_mid_{w * SECOND}"] == mid[right[i]] - mid[left[i]]
        assert (r.q.bid_amount if r.q else None) == (ba[right[i] - 1] if right[i] else None)
        past = r[f"q_past_{w * SECOND}"]
        assert (past.ask_amount if past else None) == (aa[left[i] - 1] if left[i] else None)
        exit_at = np.searchsorted(q, t[i] + 3, "right")
        out = r[f"q_exit_{3 * SECOND}"]
        assert (out.bid_amount if out else None) == (ba[exit_at - 1] if exit_at else None)
        begin = np.searchsorted(t, t[i] - w, "left")
        assert r[f"flow_n_{w * SECOND}"] == i + 1 - begin
        assert r[f"flow_buy_{w * SECOND}"] == (100 * amount[begin : i + 1])[side[begin : i + 1] == "buy"].sum()


def test_feature_sets():
    for h in (30, 120, 300):
        specs = feature_specs(h)
        assert len(specs) == 36 and len({s.name for s in specs}) == 36
    names = [s.name for s in feature_specs(30)]
    assert names[:6] == ["trade_side", "trade_signed_notional_log", "bbo_spread_bps", "bbo_top_depth_log", "bbo_vol_imb_15s", "bbo_vol_imb_30s"]
    assert names[16:21] == ["bbo_ofi_5s", "bbo_ofi_norm_5s", "bbo_ofi_15s", "bbo_ofi_norm_15s", "bbo_ofi_30s"]
    with pytest.raises(ValueError):
        feature_specs(31)


def test_one_exchange(golden, spark, capsys):
    trades = _trades(spark, [(2, 100, 1, "buy")])
    state = market_state(trades, _quotes(spark, [(1, 99, 1, 101, 1)]), None, [W], (), [W], [W])
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and math.isfinite(len(plan))
