"""Registered queries over market tables derived from ``events``, with DuckDB SQL for each that SQL can express.

Trades are purchases and clicks, quotes views and signups, liquidations errors. Prices lie on a grid
of a quarter and amounts are whole, so sums are exact in any order. Mean gaps are minutes, so windows
are hours; ``bucketed`` tables round time down to ten minutes, for ties. The SQL is written with
inequality joins and correlated conditions instead of the running differences of the plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND, finite_rows, label_weight, microseconds, sample_weight, side_sign, us_to_utc_text
from tidemark.operators import evaluation, labels, neighbours, stats, training, validation
from tidemark.operators.features import Spec
from tidemark.plans.specs import feature_specs, feature_table, market_catalog, state_for
from tidemark.sources.catalog import Catalog, Source, bounds_by_source, footer_bounds

HOUR, DAY = 3600 * SECOND, 86_400 * SECOND
BUCKET = 600 * SECOND
SCALE = 240 * SECOND  # a feature window's second: 15 become one hour
W1, W6 = 1 * HOUR, 6 * HOUR
H1, H4, H12 = 1 * HOUR, 4 * HOUR, 12 * HOUR
SHIFT = 20 * 60 * SECOND


def tables(spark: SparkSession, sf_dir: str, bucketed: bool = False) -> dict[str, DataFrame]:
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    us = microseconds("ts", events.schema["ts"].dataType)
    us = us - us % BUCKET if bucketed else us
    price = F.lit(100.0) + F.floor(F.col("value") / 25) * 0.25
    base = events.select(us.alias("timestamp"), F.col("event_id").alias("seq"), "event_type", "user_id", "event_id", price.alias("p"))
    amount = (1 + F.col("user_id") % 7).cast("double").alias("amount")
    trades = base.where("event_type in ('purchase', 'click')").select("timestamp", "seq", F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("side"), F.col("p").alias("price"), amount)
    bid = F.col("p") - 0.5
    quotes = base.where("event_type in ('view', 'signup')").select(
        "timestamp",
        "seq",
        bid.alias("bid_price"),
        (1 + F.col("event_id") % 5).cast("double").alias("bid_amount"),
        (bid + 0.5 + 0.25 * (F.col("event_id") % 3)).alias("ask_price"),
        (1 + F.col("user_id") % 5).cast("double").alias("ask_amount"),
    )
    liquidations = base.where("event_type = 'error'").select("timestamp", "seq", F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("p").alias("price"), amount)
    return {"trades": trades, "quotes": quotes, "first_feed": liquidations, "second_feed": liquidations}


def catalog(spark: SparkSession, sf_dir: str, bucketed: bool = False, back: int = 2 * DAY, ahead: int = 1 * DAY, chunk: int = 5 * DAY) -> Catalog:
    """Chunks of five days; quotes look back and ahead, feeds back, trades neither."""
    found = tables(spark, sf_dir, bucketed)
    return Catalog(found, chunk, "us", lookback={k: back for k in found if k != "trades"}, lookahead={"quotes": ahead})


def _out(c) -> object:
    """Rounded, and without negative zeros."""
    return F.round(c, 6) + 0.0


def _features(specs: list[tuple[str, str, int] | tuple[str, str, int, str]], bucketed: bool = False, delays: dict[str, int] | None = None, chunk: int = 5 * DAY, partitions: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    made = [Spec(*s) for s in specs]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        state = state_for(catalog(spark, sf_dir, bucketed, chunk=chunk), made, delays=delays or {}, partitions=partitions)
        return feature_table(state, made, narrow=False, keep=("seq",)).select("seq", *(_out(F.col(s.name)).alias(s.name) for s in made))

    return run


# --- SQL --------------------------------------------------------------------------------------


def _sql_tables(bucketed: bool = False) -> str:
    us = f"epoch_us(ts) - epoch_us(ts) % {BUCKET}" if bucketed else "epoch_us(ts)"
    price = "100.0 + floor(value / 25) * 0.25"
    return f"""WITH RECURSIVE t0 AS (
  SELECT {us} AS ts, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign,
         ({price})::DOUBLE AS px, (1 + user_id % 7)::DOUBLE AS am FROM events WHERE event_type IN ('purchase', 'click')),
q0 AS (
  SELECT {us} AS ts, event_id AS seq, ({price} - 0.5)::DOUBLE AS bp, (1 + event_id % 5)::DOUBLE AS ba,
         ({price} + 0.25 * (event_id % 3))::DOUBLE AS ap, (1 + user_id % 5)::DOUBLE AS aa FROM events WHERE event_type IN ('view', 'signup')),
l0 AS (
  SELECT {us} AS ts, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
         (({price}) * (1 + user_id % 7))::DOUBLE AS no FROM events WHERE event_type = 'error'),
bounds AS (
  SELECT min(ts) AS s, max(ts) + 1 AS e FROM (SELECT ts FROM t0 UNION ALL SELECT ts FROM q0 UNION ALL SELECT ts FROM l0)),
c AS (
  SELECT i AS chunk, s + i * {5 * DAY} AS a, least(s + (i + 1) * {5 * DAY}, e) AS b, e
  FROM bounds, range(0, (SELECT CAST(ceil((e - s) / {5 * DAY}.0) AS BIGINT) FROM bounds)) r(i)),
t AS (SELECT c.chunk, t0.* FROM t0 JOIN c ON ts >= a AND ts < b),
q AS (SELECT c.chunk, q0.*, row_number() OVER (PARTITION BY c.chunk ORDER BY ts, q0.seq) AS pos FROM q0 JOIN c ON ts >= a - {2 * DAY} AND ts < least(b + {DAY}, e)),
l AS (SELECT c.chunk, l0.* FROM l0 JOIN c ON ts >= a - {2 * DAY} AND ts < b),
qf AS (
  SELECT x.*, CASE WHEN p.pos IS NULL THEN x.ba - x.aa ELSE
    (CASE WHEN x.bp > p.bp THEN x.ba WHEN x.bp = p.bp THEN x.ba - p.ba ELSE -p.ba END)
    - (CASE WHEN x.ap < p.ap THEN x.aa WHEN x.ap = p.ap THEN x.aa - p.aa ELSE -p.aa END) END AS ofi
  FROM q x LEFT JOIN q p ON p.chunk = x.chunk AND p.pos = x.pos - 1)"""


_SNAP = """,
st AS (
  SELECT t.seq, any_value(t.sign) AS sign, any_value(t.px) AS px, any_value(t.am) AS am, max(q.pos) AS pos, any_value(t.chunk) AS chunk
  FROM t LEFT JOIN q ON q.chunk = t.chunk AND q.ts <= t.ts GROUP BY t.seq),
s AS (SELECT st.*, q.ts AS qts, bp, ba, ap, aa, (bp + ap) / 2 AS mid FROM st LEFT JOIN q ON q.chunk = st.chunk AND q.pos = st.pos)"""


def _quote_window(w: int) -> str:
    return f""",
w AS (
  SELECT t.seq, count(qf.pos) AS n, sum((bp + ap) / 2) AS mids, coalesce(sum(ofi), 0) AS ofi
  FROM t LEFT JOIN qf ON qf.chunk = t.chunk AND qf.ts >= t.ts - {w} AND qf.ts <= t.ts GROUP BY t.seq),
pp AS (SELECT t.seq, max(q.pos) AS pos, any_value(t.chunk) AS chunk FROM t JOIN q ON q.chunk = t.chunk AND q.ts < t.ts - {w} GROUP BY t.seq),
past AS (SELECT pp.seq, (bp + ap) / 2 AS mid FROM pp JOIN q ON q.chunk = pp.chunk AND q.pos = pp.pos)"""


def _feed_window(w: int, shift: int = 0) -> str:
    return f""",
w AS (
  SELECT t.seq, any_value(t.sign) AS sign, count(l.seq) AS n, coalesce(sum(CASE WHEN side = 'buy' THEN no END), 0) AS b, coalesce(sum(CASE WHEN side = 'sell' THEN no END), 0) AS s
  FROM t LEFT JOIN l ON l.chunk = t.chunk AND l.ts + {shift} >= t.ts - {w} AND l.ts + {shift} <= t.ts GROUP BY t.seq)"""


def _flow_window(w: int) -> str:
    return f""",
w AS (
  SELECT t.seq, any_value(t.sign) AS sign, count(*) AS n, coalesce(sum(CASE WHEN o.sign > 0 THEN o.px * o.am END), 0) AS b, coalesce(sum(CASE WHEN o.sign < 0 THEN o.px * o.am END), 0) AS s
  FROM t JOIN t o ON o.chunk = t.chunk AND o.ts >= t.ts - {w} AND (o.ts < t.ts OR (o.ts = t.ts AND o.seq <= t.seq)) GROUP BY t.seq)"""


def _r(expr: str, name: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0 AS {name}"


_V = "CASE WHEN mid IS NULL THEN 0 ELSE {} END"
_IMB = _V.format("(ba - aa) / (ba + aa)")
_SNAPSHOT = ", ".join(
    [
        _r(_V.format("(ap - bp) / mid * 10000"), "spread"),
        _r(_IMB, "imbalance"),
        _r(f"abs({_IMB})", "imbalance_abs"),
        _r(_V.format("ln(1 + bp * ba + ap * aa)"), "depth_log"),
        _r(_V.format("((ap * ba + bp * aa) / (ba + aa) - mid) / mid * 10000"), "micro"),
        _r(_V.format("-sign * (mid - px) / px * 10000"), "edge"),
        _r(_V.format("(bp * ba - ap * aa) / (bp * ba + ap * aa)"), "depth_value"),
        _r(f"sign * {_IMB}", "side_imbalance"),
        _r("sign * " + _V.format("((ap * ba + bp * aa) / (ba + aa) - mid) / mid * 10000"), "side_micro"),
    ]
)
_SNAPSHOT_SPECS = [
    ("spread", "spread_bps", 0),
    ("imbalance", "volume_imbalance", 0),
    ("imbalance_abs", "volume_imbalance_abs", 0),
    ("depth_log", "top_depth_log", 0),
    ("micro", "micro_price_premium_bps", 0),
    ("edge", "edge_bps", 0),
    ("depth_value", "depth_imbalance_value", 0),
    ("side_imbalance", "side_volume_imbalance", 0),
    ("side_micro", "side_micro_price_premium_bps", 0),
]
_SMOOTH = "CASE WHEN s.mid IS NOT NULL AND n > 0 THEN (s.mid - mids / n) / (mids / n) * 10000 ELSE 0 END"
_DELTA = "CASE WHEN s.mid IS NOT NULL AND past.mid IS NOT NULL THEN (s.mid - past.mid) / past.mid * 10000 ELSE 0 END"
_BAL = "CASE WHEN b + s > 0 THEN (b - s) / (b + s) ELSE 0 END"
_STRENGTH = "sign(b - s) * ln(1 + abs(b - s))"

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _feature_query(name: str, specs: list, sql: str, bucketed: bool = False, delays: dict[str, int] | None = None) -> None:
    Q[name] = _features(specs, bucketed, delays)
    SQL[name] = _sql_tables(bucketed) + sql


_feature_query("asof_spread", _SNAPSHOT_SPECS[:1], _SNAP + f"SELECT seq, {_r(_V.format('(ap - bp) / mid * 10000'), 'spread')} FROM s")
_feature_query("asof_snapshot_features", _SNAPSHOT_SPECS, _SNAP + f"SELECT seq, {_SNAPSHOT} FROM s")
_feature_query("asof_ties", _SNAPSHOT_SPECS, _SNAP + f"SELECT seq, {_SNAPSHOT} FROM s", bucketed=True)
_smooth = _SNAP + _quote_window(W6) + f"SELECT s.seq, {_r(_SMOOTH, 'smooth')}, {_r('sign * ' + _SMOOTH, 'side_smooth')} FROM s JOIN w USING (seq)"
_feature_query("mid_smooth_delta", [("smooth", "mid_smooth_delta_bps", W6), ("side_smooth", "side_mid_smooth_delta_bps", W6)], _smooth)
_feature_query("mid_smooth_delta_ties", [("smooth", "mid_smooth_delta_bps", W6), ("side_smooth", "side_mid_smooth_delta_bps", W6)], _smooth, bucketed=True)
_delta = _SNAP + _quote_window(W6) + f"SELECT s.seq, {_r(_DELTA, 'delta')}, {_r('sign * ' + _DELTA, 'side_delta')} FROM s LEFT JOIN past USING (seq)"
_feature_query("mid_delta", [("delta", "mid_delta_bps", W6), ("side_delta", "side_mid_delta_bps", W6)], _delta)
_feature_query("mid_delta_ties", [("delta", "mid_delta_bps", W6), ("side_delta", "side_mid_delta_bps", W6)], _delta, bucketed=True)
_ofi = _SNAP + _quote_window(W6) + f"SELECT s.seq, {_r('ofi', 'ofi')}, {_r('sign * ofi', 'side_ofi')}, {_r('CASE WHEN mid IS NULL THEN 0 ELSE ofi / (ba + aa) END', 'ofi_norm')} FROM s JOIN w USING (seq)"
_ofi_specs = [("ofi", "order_flow_imbalance", W6), ("side_ofi", "side_order_flow_imbalance", W6), ("ofi_norm", "order_flow_imbalance_norm", W6)]
_feature_query("ofi_window", _ofi_specs, _ofi)
_feature_query("ofi_ties", _ofi_specs, _ofi, bucketed=True)
_feature_query(
    "trade_notional",
    [("side", "trade_side", 0), ("log_notional", "trade_notional_log", 0), ("signed_log_notional", "trade_signed_notional_log", 0)],
    f"SELECT seq, {_r('sign', 'side')}, {_r('ln(1 + px * am)', 'log_notional')}, {_r('sign * ln(1 + px * am)', 'signed_log_notional')} FROM t",
)
_flow_specs = [("imbalance", "flow_imbalance", W6), ("side_imbalance", "side_flow_imbalance", W6), ("toxicity", "flow_toxicity", W6), ("log_notional", "flow_notional_log", W6), ("log_count", "flow_count_log", W6)]
_flow = _flow_window(W6) + f"SELECT seq, {_r(_BAL, 'imbalance')}, {_r(f'sign * {_BAL}', 'side_imbalance')}, {_r(f'abs({_BAL})', 'toxicity')}, {_r('ln(1 + b + s)', 'log_notional')}, {_r('ln(1 + n)', 'log_count')} FROM w"
_feature_query("trade_flow", _flow_specs, _flow)
_feature_query("trade_flow_ties", _flow_specs, _flow, bucketed=True)
_liq_specs = [
    ("imbalance", "feed_imbalance", W6, "first_feed"),
    ("strength", "feed_strength", W6, "first_feed"),
    ("total", "feed_total_notional_log", W6, "first_feed"),
    ("events", "feed_count_log", W6, "first_feed"),
    ("mean", "feed_mean_notional_log", W6, "first_feed"),
    ("side_imbalance", "side_feed_imbalance", W6, "first_feed"),
    ("side_strength", "side_feed_strength", W6, "first_feed"),
]
_liq = f"SELECT seq, {_r(_BAL, 'imbalance')}, {_r(_STRENGTH, 'strength')}, {_r('ln(1 + b + s)', 'total')}, {_r('ln(1 + n)', 'events')}, {_r('CASE WHEN n > 0 THEN ln(1 + (b + s) / n) ELSE 0 END', 'mean')}, {_r(f'sign * {_BAL}', 'side_imbalance')}, {_r(f'sign * {_STRENGTH}', 'side_strength')} FROM w"
_feature_query("liquidation_features", _liq_specs, _feed_window(W6) + _liq)
_feature_query("liquidation_ties", _liq_specs, _feed_window(W6) + _liq, bucketed=True)
_feature_query("liquidation_shifted", _liq_specs, _feed_window(W6, SHIFT) + _liq, delays={"first_feed": SHIFT})


# --- labels ------------------------------------------------------------------------------------

HORIZONS = (H1, H4, H12)


def labelled(spark: SparkSession, sf_dir: str, bucketed: bool = False, chunk: int = 5 * DAY, partitions: int | None = None) -> DataFrame:
    state = state_for(catalog(spark, sf_dir, bucketed, chunk=chunk), [Spec("spread", "spread_bps")], HORIZONS, partitions=partitions)
    return labels.with_pnl(state, HORIZONS)


def _hours(h: int) -> str:
    return f"{h // HOUR}h"


def labels_pnl(bucketed: bool = False, chunk: int = 5 * DAY, partitions: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = labelled(spark, sf_dir, bucketed, chunk, partitions)
        marks = labels.marks(df, HORIZONS)
        return df.select(
            "seq",
            *(_out(F.coalesce(F.col(f"pnl_{h}"), F.lit(-1e9))).alias(f"pnl_{_hours(h)}") for h in HORIZONS),
            *(F.col(f"valid_{h}").alias(f"valid_{_hours(h)}") for h in HORIZONS),
            *(marks[f"mark_{h}"].cast("int").alias(f"mark_{_hours(h)}") for h in HORIZONS),
            _out(F.col("weight")).alias("weight"),
        )

    return run


def _sql_labels(bucketed: bool = False) -> str:
    out = _sql_tables(bucketed) + ",\nlast AS (SELECT chunk, max(ts) AS qlast FROM q GROUP BY chunk)"
    for h in HORIZONS:
        k = _hours(h)
        out += f""",
x{k} AS (SELECT t.seq, max(q.pos) AS pos, any_value(t.chunk) AS chunk FROM t JOIN q ON q.chunk = t.chunk AND q.ts <= t.ts + {h} GROUP BY t.seq),
p{k} AS (
  SELECT t.seq, CASE WHEN t.ts + {h} <= qlast THEN -sign * ((bp + ap) / 2 - px) / px * 10000 + 0.5 END AS pnl
  FROM t JOIN x{k} x ON x.seq = t.seq JOIN q ON q.chunk = x.chunk AND q.pos = x.pos JOIN last ON last.chunk = t.chunk)"""
    ks = [_hours(h) for h in HORIZONS]
    return (
        out
        + ",\nlab AS (SELECT t.seq, t.ts, t.sign, t.px, t.am, least(px * am, 100000) AS weight, "
        + ", ".join(f"p{k}.pnl AS pnl_{k}" for k in ks)
        + " FROM t "
        + " ".join(f"LEFT JOIN p{k} ON p{k}.seq = t.seq" for k in ks)
        + ")"
    )


_labels_out = "SELECT seq, " + ", ".join(
    [_r(f"coalesce(pnl_{_hours(h)}, -1e9)", f"pnl_{_hours(h)}") for h in HORIZONS]
    + [f"pnl_{_hours(h)} IS NOT NULL AS valid_{_hours(h)}" for h in HORIZONS]
    + [f"CASE WHEN pnl_{_hours(h)} <= 0 THEN 1 ELSE 0 END AS mark_{_hours(h)}" for h in HORIZONS]
    + [_r("weight", "weight")]
)
Q["labels_pnl"], SQL["labels_pnl"] = labels_pnl(), _sql_labels() + _labels_out + " FROM lab"
Q["labels_ties"], SQL["labels_ties"] = labels_pnl(True), _sql_labels(True) + _labels_out + " FROM lab"


def label_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages with the sells filtered out."""
    out = labels.averages(labelled(spark, sf_dir), HORIZONS, {h: F.col("side") == "sell" for h in HORIZONS})
    return out.select((F.col("horizon") / HOUR).cast("int").alias("hours"), *(_out(F.col(c)).alias(c) for c in ("pnl_all", "pnl_kept", "pnl_filtered", "score")))


Q["label_averages"] = label_averages
SQL["label_averages"] = (
    _sql_labels()
    + " SELECT hours, "
    + ", ".join([_r("pnl_all", "pnl_all"), _r("pnl_kept", "pnl_kept"), _r("pnl_filtered", "pnl_filtered"), _r("pnl_kept - pnl_all", "score")])
    + " FROM ("
    + " UNION ALL ".join(
        f"SELECT {h // HOUR} AS hours, sum(weight * pnl_{_hours(h)}) / sum(CASE WHEN pnl_{_hours(h)} IS NOT NULL THEN weight END) AS pnl_all, "
        f"sum(CASE WHEN sign > 0 THEN weight * pnl_{_hours(h)} END) / sum(CASE WHEN sign > 0 AND pnl_{_hours(h)} IS NOT NULL THEN weight END) AS pnl_kept, "
        f"sum(CASE WHEN sign < 0 THEN weight * pnl_{_hours(h)} END) / sum(CASE WHEN sign < 0 AND pnl_{_hours(h)} IS NOT NULL THEN weight END) AS pnl_filtered FROM lab"
        for h in HORIZONS
    )
    + ")"
)


# --- sources, chunks, weights, validation ---------------------------------------------------------


def chunk_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table each chunk sees."""
    cat = catalog(spark, sf_dir)
    out = None
    for name in ("trades", "quotes", "first_feed"):
        one = cat.chunked(name).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


Q["chunk_assignment"] = chunk_assignment
SQL["chunk_assignment"] = _sql_tables() + " " + " UNION ALL ".join(f"SELECT chunk AS chunk_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, '{name}' AS source FROM {t} GROUP BY chunk" for name, t in (("trades", "t"), ("quotes", "q"), ("first_feed", "l")))

Q["source_bounds"] = lambda spark, sf_dir: bounds_by_source({k: v for k, v in tables(spark, sf_dir).items() if k != "second_feed"})
SQL["source_bounds"] = _sql_tables() + " " + " UNION ALL ".join(f"SELECT '{name}' AS source, min(ts) AS first_ts, max(ts) AS last_ts FROM {t}" for name, t in (("trades", "t0"), ("quotes", "q0"), ("first_feed", "l0")))

_KEYS = {"events": "event_id", "orders": "o_orderkey", "lineitem": "l_orderkey"}
Q["footer_bounds"] = lambda spark, sf_dir: footer_bounds(spark, [Source(name, f"{sf_dir.rstrip('/')}/{name}.parquet") for name in _KEYS], _KEYS)
SQL["footer_bounds"] = " UNION ALL ".join(f"SELECT '{name}' AS source, min({key}) AS first_ts, max({key}) AS last_ts FROM {name}" for name, key in _KEYS.items())

for _name, _method, _len in (("first_hour", "first_hour", HOUR), ("first_day", "first_day", DAY), ("first_two_weeks", "first_two_weeks", 14 * DAY)):
    Q[_name] = lambda spark, sf_dir, method=_method: getattr(catalog(spark, sf_dir), method)()["trades"]
    SQL[_name] = _sql_tables() + f" SELECT ts AS timestamp, seq, CASE WHEN sign > 0 THEN 'buy' ELSE 'sell' END AS side, px AS price, am AS amount FROM t0, bounds WHERE ts >= s AND ts < s + {_len}"


def time_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalog(spark, sf_dir)
    return cat.between(cat.start + 3 * DAY, cat.start + 4 * DAY)["quotes"]


Q["time_range_scan"] = time_range_scan
SQL["time_range_scan"] = _sql_tables() + f" SELECT ts AS timestamp, seq, bp AS bid_price, ba AS bid_amount, ap AS ask_price, aa AS ask_amount FROM q0, bounds WHERE ts >= s + {3 * DAY} AND ts < s + {4 * DAY}"


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both capped weights, the strict sign and the time as text."""
    t = finite_rows(tables(spark, sf_dir)["trades"], "price", "amount")
    t = t.withColumn("amount", F.col("amount") * 300)
    return t.select(
        "seq",
        label_weight(F.col("price"), F.col("amount")).alias("label_weight"),
        sample_weight(F.col("price"), F.col("amount")).cast("double").alias("sample_weight"),
        side_sign(F.col("side"), t.schema["side"].dataType).alias("sign"),
        us_to_utc_text(F.col("timestamp")).alias("at"),
    )


Q["weights"] = weights
SQL["weights"] = _sql_tables() + " SELECT seq, least(px * am * 300, 100000) AS label_weight, least((px * am * 300)::FLOAT, 100000::FLOAT)::DOUBLE AS sample_weight, sign, strftime(make_timestamp(ts), '%Y-%m-%d %H:%M:%S UTC') AS at FROM t0"

_MAX_USED = [Spec("snap", "spread_bps"), Spec("smooth", "mid_smooth_delta_bps", W1), Spec("liq", "feed_strength", W6, "first_feed"), Spec("own", "trade_side")]


def max_used_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = state_for(catalog(spark, sf_dir), _MAX_USED, delays={"first_feed": SHIFT})
    return feature_table(state, _MAX_USED, keep=("seq",), max_used=True).select("seq", *(f"mu_{s.name}" for s in _MAX_USED))


Q["max_used_ts"] = max_used_ts
SQL["max_used_ts"] = _sql_tables() + f"""
SELECT t.seq,
  coalesce((SELECT max(q.ts) FROM q WHERE q.chunk = t.chunk AND q.ts <= t.ts), t.ts) AS mu_snap,
  coalesce((SELECT max(q.ts) FROM q WHERE q.chunk = t.chunk AND q.ts <= t.ts AND q.ts >= t.ts - {W1}), t.ts) AS mu_smooth,
  coalesce((SELECT max(l.ts + {SHIFT}) FROM l WHERE l.chunk = t.chunk AND l.ts + {SHIFT} <= t.ts AND l.ts + {SHIFT} >= t.ts - {W6}), t.ts) AS mu_liq,
  t.ts AS mu_own
FROM t"""


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature set as it is, and four spoilt columns."""
    state = state_for(catalog(spark, sf_dir), _MAX_USED)
    table = feature_table(state, _MAX_USED, max_used=True)
    spoilt = table.withColumns(
        {
            "bad_nan": F.when(F.col("seq") % 7 == 0, float("nan")).otherwise(1.0),
            "bad_null": F.when(F.col("seq") % 7 != 0, 1.0),
            "bad_inf": F.when(F.col("seq") % 7 == 0, float("-inf")).otherwise(1.0),
            "bad_late": F.lit(1.0),
            "mu_bad_late": F.col("timestamp") + F.when(F.col("seq") % 7 == 0, 1).otherwise(0),
        }
    )
    return validation.report(spoilt, [*(s.name for s in _MAX_USED), "bad_nan", "bad_null", "bad_inf", "bad_late"], "timestamp")


Q["validation_report"] = validation_report
SQL["validation_report"] = "SELECT * FROM (VALUES ('snap', 'OK'), ('smooth', 'OK'), ('liq', 'OK'), ('own', 'OK'), ('bad_nan', 'HAS_NANS'), ('bad_null', 'HAS_NANS'), ('bad_inf', 'HAS_INFS'), ('bad_late', 'FORWARD_LOOKING')) v(feature, status)"


# --- feature sets --------------------------------------------------------------------------------


def feature_matrix(horizon: int, chunk: int = 5 * DAY, partitions: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    specs = feature_specs(horizon, scale=SCALE)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        state = state_for(catalog(spark, sf_dir, chunk=chunk), specs, delays={"second_feed": SHIFT}, partitions=partitions)
        return feature_table(state, specs, narrow=False, keep=("seq",)).select("seq", *(_out(F.col(s.name)).alias(s.name) for s in specs))

    return run


def _sql_matrix(horizon: int) -> str:
    """Every column by its own sub-query over the trades."""
    specs = feature_specs(horizon, scale=SCALE)
    sql, columns, joined = _sql_tables() + _SNAP, [], {}
    snap = {"spread_bps": "(ap - bp) / mid * 10000", "top_depth_log": "ln(1 + bp * ba + ap * aa)", "volume_imbalance": "(ba - aa) / (ba + aa)", "depth_imbalance_value": "(bp * ba - ap * aa) / (bp * ba + ap * aa)", "micro_price_premium_bps": "((ap * ba + bp * aa) / (ba + aa) - mid) / mid * 10000", "edge_bps": "-s.sign * (mid - px) / px * 10000"}
    for spec in specs:
        w, f = spec.window_us, spec.feature
        if f == "trade_side":
            value = "s.sign"
        elif f == "trade_signed_notional_log":
            value = "s.sign * ln(1 + px * am)"
        elif f in snap:
            value = f"CASE WHEN s.mid IS NULL THEN 0 ELSE {snap[f].replace('mid', 's.mid')} END"
        else:
            kind = "flow" if f.startswith("flow") else spec.feed or "quote"
            k = f"{kind}_{w // SECOND}"
            if k not in joined:
                body = _flow_window(w) if kind == "flow" else _feed_window(w, SHIFT if kind == "second_feed" else 0) if spec.feed else _quote_window(w)
                joined[k] = body.replace("\nw AS (", f"\nw_{k} AS (").replace("\npp AS (", f"\npp_{k} AS (").replace("\npast AS (", f"\npast_{k} AS (").replace("FROM pp JOIN q ON q.chunk = pp.chunk AND q.pos = pp.pos", f"FROM pp_{k} pp JOIN q ON q.chunk = pp.chunk AND q.pos = pp.pos")
            a = f"w_{k}"
            b, s = f"{a}.b", f"{a}.s"
            value = {
                "mid_smooth_delta_bps": f"CASE WHEN s.mid IS NOT NULL AND {a}.n > 0 THEN (s.mid - {a}.mids / {a}.n) / ({a}.mids / {a}.n) * 10000 ELSE 0 END",
                "mid_delta_bps": f"CASE WHEN s.mid IS NOT NULL AND past_{k}.mid IS NOT NULL THEN (s.mid - past_{k}.mid) / past_{k}.mid * 10000 ELSE 0 END",
                "order_flow_imbalance": f"{a}.ofi",
                "order_flow_imbalance_norm": f"CASE WHEN s.mid IS NULL THEN 0 ELSE {a}.ofi / (ba + aa) END",
                "flow_imbalance": f"CASE WHEN {b} + {s} > 0 THEN ({b} - {s}) / ({b} + {s}) ELSE 0 END",
                "flow_toxicity": f"CASE WHEN {b} + {s} > 0 THEN abs({b} - {s}) / ({b} + {s}) ELSE 0 END",
                "flow_notional_log": f"ln(1 + {b} + {s})",
                "flow_count_log": f"ln(1 + {a}.n)",
                "feed_strength": f"sign({b} - {s}) * ln(1 + abs({b} - {s}))",
                "side_feed_strength": f"s.sign * sign({b} - {s}) * ln(1 + abs({b} - {s}))",
                "feed_total_notional_log": f"ln(1 + {b} + {s})",
            }[f]
        columns.append(_r(value, spec.name))
    sql += "".join(joined.values()) + f"\nSELECT s.seq, {', '.join(columns)} FROM s"
    for k in joined:
        sql += f" JOIN w_{k} ON w_{k}.seq = s.seq" + (f" LEFT JOIN past_{k} ON past_{k}.seq = s.seq" if k.startswith("quote") else "")
    return sql


def narrow_matrix(horizon: int) -> Callable[[SparkSession, str], DataFrame]:
    """The matrix as models get it: every column narrowed to float, signed ones before the sign is taken in."""
    specs = feature_specs(horizon, scale=SCALE)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        state = state_for(catalog(spark, sf_dir), specs, delays={"second_feed": SHIFT})
        return feature_table(state, specs, keep=("seq",)).select("seq", *((F.round(F.col(s.name).cast("double"), 3) + 0.0).alias(s.name) for s in specs))

    return run


for _h in (30, 120, 300):
    Q[f"feature_matrix_{_h}"], SQL[f"feature_matrix_{_h}"] = feature_matrix(_h), _sql_matrix(_h)
    Q[f"feature_matrix_{_h}_float"] = narrow_matrix(_h)
    SQL[f"feature_matrix_{_h}_float"] = _sql_matrix(_h).replace(")::DOUBLE, 6) + 0.0 AS ", ")::FLOAT::DOUBLE, 3) + 0.0 AS ")


# --- one busy chunk: the whole table as one chunk, dealt over tasks by ranges of time ------------------

ONE_CHUNK, RANGES = 10_000 * DAY, 8


def _in_one_chunk(sql: str) -> str:
    return sql.replace(str(5 * DAY), str(ONE_CHUNK))


for _name, _specs in (("asof_ties", _SNAPSHOT_SPECS), ("mid_delta_ties", [("delta", "mid_delta_bps", W6), ("side_delta", "side_mid_delta_bps", W6)]), ("ofi_ties", _ofi_specs), ("trade_flow_ties", _flow_specs), ("liquidation_ties", _liq_specs)):
    Q[f"{_name}_one_chunk"] = _features(_specs, bucketed=True, chunk=ONE_CHUNK, partitions=RANGES)
    SQL[f"{_name}_one_chunk"] = _in_one_chunk(SQL[_name])
Q["labels_ties_one_chunk"], SQL["labels_ties_one_chunk"] = labels_pnl(True, ONE_CHUNK, RANGES), _in_one_chunk(SQL["labels_ties"])
Q["feature_matrix_120_one_chunk"], SQL["feature_matrix_120_one_chunk"] = feature_matrix(120, ONE_CHUNK, RANGES), _in_one_chunk(SQL["feature_matrix_120"])


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and weight of every trade as models get them."""
    weight = sample_weight(F.col("price"), F.col("amount")).cast("double")
    return labelled(spark, sf_dir).select("seq", _out(F.coalesce(labels.target(H4).cast("double"), F.lit(-1e9))).alias("label"), weight.alias("weight"))


Q["training_rows"] = training_rows
SQL["training_rows"] = _sql_labels() + f" SELECT seq, {_r('coalesce((-pnl_4h)::FLOAT::DOUBLE, -1e9)', 'label')}, least((px * am)::FLOAT, 100000::FLOAT)::DOUBLE AS weight FROM lab"


# --- evaluation -----------------------------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic score with ties against the pnl of one horizon."""
    df = labelled(spark, sf_dir).where(F.col(f"valid_{H4}"))
    return df.select("timestamp", "seq", (F.col("price") + F.col("seq") % 5).alias("score"), F.round(f"pnl_{H4}", 6).alias("pnl"), F.col("weight"), F.lit(True).alias("valid"))


_PRED = _sql_labels() + ",\npred AS (SELECT ts, seq, px + seq % 5 AS score, round(pnl_4h, 6) AS pnl, weight FROM lab WHERE pnl_4h IS NOT NULL)"
_RANK = _PRED + ",\nranked AS (SELECT *, row_number() OVER o AS place, sum(weight) OVER o AS cw, sum(pnl * weight) OVER o AS cp FROM pred WINDOW o AS (ORDER BY score DESC, ts DESC, seq DESC ROWS UNBOUNDED PRECEDING))"
_CURVE = (
    _RANK
    + """,
tot AS (SELECT count(*) AS n, sum(weight) AS w, sum(pnl * weight) AS p, sqrt(sum(weight * (score + pnl) * (score + pnl)) / sum(weight)) AS rmse, sum(weight * abs(score + pnl)) / sum(weight) AS mae FROM pred),
cuts AS (SELECT CASE WHEN i = 30 THEN 0.3::DOUBLE ELSE i * (0.3::DOUBLE / 30) END AS f FROM range(0, 31) r(i)),
k AS (SELECT f, CAST(floor(n * f) AS BIGINT) AS k FROM cuts, tot),
pt AS (SELECT f, coalesce(cw, 0) AS cw, coalesce(cp, 0) AS cp FROM k LEFT JOIN ranked ON place = k),
curve AS (
  SELECT 'core' AS experiment, 300 AS horizon_sec, f, (p - cp) / (w - cw) - p / w AS score, p / w AS pa, (p - cp) / (w - cw) AS pk,
    CASE WHEN cw > 0 THEN cp / cw ELSE -1e9 END AS pf, cw / 30 AS ft, (w - cw) / 30 AS kt, rmse, mae FROM pt, tot)"""
)
_CURVE_OUT = "experiment, horizon_sec, " + ", ".join(
    _r(a, b)
    for a, b in (
        ("f", "filter_fraction"),
        ("score", "score_bps"),
        ("pa", "pnl_all_bps"),
        ("pk", "pnl_kept_bps"),
        ("pf", "pnl_filtered_bps"),
        ("round(ft, 3)", "filtered_turnover_per_day"),
        ("round(kt, 3)", "kept_turnover_per_day"),
        ("rmse", "weighted_rmse_badness_bps"),
        ("mae", "weighted_mae_badness_bps"),
    )
)


def _curve_out(df: DataFrame) -> DataFrame:
    numbers = [c for c in df.columns if c not in ("experiment", "horizon_sec")]
    rounded = {c: (F.round(F.col(c), 3) if "turnover" in c else F.coalesce(F.col(c), F.lit(-1e9))) for c in numbers}
    return df.select("experiment", "horizon_sec", *(_out(x).alias(c) for c, x in rounded.items()))


def filter_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve_out(evaluation.evaluate_predictions(spark, predictions(spark, sf_dir), 30.0, horizon_sec=300))


Q["filter_fraction_curve"], SQL["filter_fraction_curve"] = filter_curve, _CURVE + f" SELECT {_CURVE_OUT} FROM curve"


def filter_curve_own_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover by the days that the catalog spans."""
    found = catalog(spark, sf_dir)
    days = evaluation.evaluation_days(found.start, found.end)
    return _curve_out(evaluation.evaluate_predictions(spark, predictions(spark, sf_dir), days, horizon_sec=300))


_DAYS = f"greatest(1.0, (SELECT (e - s)::DOUBLE FROM bounds) / {DAY})"
Q["filter_curve_own_days"], SQL["filter_curve_own_days"] = filter_curve_own_days, _CURVE.replace("cw / 30 AS ft, (w - cw) / 30 AS kt", f"cw / {_DAYS} AS ft, (w - cw) / {_DAYS} AS kt") + f" SELECT {_CURVE_OUT} FROM curve"


def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.worst_first(spark, predictions(spark, sf_dir)).select("seq", F.col("place").cast("long").alias("place"), F.round("cum_weight", 3).alias("cum_weight"), F.round("cum_pnl", 2).alias("cum_pnl"))


Q["worst_first"], SQL["worst_first"] = worst_first, _RANK + " SELECT seq, place, round(cw, 3) AS cum_weight, round(cp, 2) AS cum_pnl FROM ranked"


def weighted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.weighted_errors(predictions(spark, sf_dir)).select(*(_out(F.col(c)).alias(c) for c in ("weighted_rmse", "weighted_mae")))


Q["weighted_errors"] = weighted_errors
SQL["weighted_errors"] = _PRED + f" SELECT {_r('sqrt(sum(weight * (score + pnl) * (score + pnl)) / sum(weight))', 'weighted_rmse')}, {_r('sum(weight * abs(score + pnl)) / sum(weight)', 'weighted_mae')} FROM pred"


def best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = evaluation.evaluate_predictions(spark, predictions(spark, sf_dir), 30.0, horizon_sec=300)
    return _curve_out(evaluation.best_row(curve, least=1000.0))


Q["best_row"], SQL["best_row"] = best_row, _CURVE + f" SELECT {_CURVE_OUT} FROM (SELECT * FROM curve WHERE kt >= 1000 ORDER BY score DESC, f LIMIT 1)"


def summary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    curves = [evaluation.curve(spark, p, 30.0, horizon_sec=h, max_fraction=0.05) for h in (30, 300)]
    return _curve_out(evaluation.summary(curves, least=1000.0))


Q["summary_union"] = summary_union
SQL["summary_union"] = (
    _CURVE.replace("CASE WHEN i = 30 THEN 0.3::DOUBLE ELSE i * (0.3::DOUBLE / 30) END AS f FROM range(0, 31)", "CASE WHEN i = 5 THEN 0.05::DOUBLE ELSE i * (0.05::DOUBLE / 5) END AS f FROM range(0, 6)")
    + f", two AS (SELECT * FROM curve WHERE kt >= 1000 UNION ALL SELECT * REPLACE (30 AS horizon_sec) FROM curve WHERE kt >= 1000) SELECT {_CURVE_OUT} FROM two"
)


# --- statistics -------------------------------------------------------------------------------------


def _stat(column: str, run: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, tables(spark, sf_dir)["trades"]).select(F.round(column, 6).alias(column))


Q["entropy"], SQL["entropy"] = _stat("entropy", lambda _, t: stats.entropy(t, "price")), _sql_tables() + " SELECT round(entropy(px), 6) AS entropy FROM t0"
Q["spearman"] = _stat("spearman", lambda spark, t: stats.spearman(spark, t, "price", "amount"))
SQL["spearman"] = _sql_tables() + " SELECT round(corr(rx, ry), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY px) + (count(*) OVER (PARTITION BY px) - 1) / 2.0 AS rx, rank() OVER (ORDER BY am) + (count(*) OVER (PARTITION BY am) - 1) / 2.0 AS ry FROM t0)"
Q["ks"] = _stat("ks", lambda spark, t: stats.ks(spark, t.where("side = 'buy'"), t.where("side = 'sell'"), "price"))
SQL["ks"] = _sql_tables() + ", v AS (SELECT DISTINCT px AS x FROM t0) SELECT round(max(abs((SELECT count(*) FILTER (px <= x) / count(*) FROM t0 WHERE sign > 0) - (SELECT count(*) FILTER (px <= x) / count(*) FROM t0 WHERE sign < 0))), 6) AS ks FROM v"
Q["linear_r2"], SQL["linear_r2"] = _stat("r2", lambda _, t: stats.linear_r2(t, "price", "amount")), _sql_tables() + " SELECT round(regr_r2(am, px), 6) AS r2 FROM t0"
Q["tree_r2"] = _stat("r2", lambda _, t: stats.tree_r2(t, ["price"], "amount"))
Q["mutual_information"] = _stat("mutual_information", lambda _, t: stats.mutual_information(t, "price", "amount"))
_SHARES = "[" + ", ".join(f"{i / 16}" for i in range(1, 16)) + "]"
SQL["mutual_information"] = (
    _sql_tables()
    + f""",
edges AS (SELECT quantile_disc(px, {_SHARES}) AS ex, quantile_disc(am, {_SHARES}) AS ey FROM t0),
cells AS (SELECT len(list_filter(ex, lambda v: v < px)) AS i, len(list_filter(ey, lambda v: v < am)) AS j FROM t0, edges),
joint AS (SELECT i, j, count(*) AS c FROM cells GROUP BY i, j),
part AS (SELECT c / sum(c) OVER () * ln(c * sum(c) OVER () / (sum(c) OVER (PARTITION BY i) * sum(c) OVER (PARTITION BY j))) AS part FROM joint)
SELECT round(greatest(sum(part), 0), 6) AS mutual_information FROM part"""
)

# all columns of a feature matrix at once
_ALL = [s.name for s in feature_specs(120, scale=SCALE)]
_Y = "trade_signed_notional_log"
_LONG = f", m AS MATERIALIZED ({{}}), u AS (SELECT seq, feature, v, y FROM (UNPIVOT (SELECT *, {_Y} AS y FROM m) ON {', '.join(_ALL)} INTO NAME feature VALUE v))"


def _sql_long(rest: str) -> str:
    with_, select = _sql_matrix(120).rsplit("\nSELECT ", 1)
    return with_ + _LONG.format("SELECT " + select) + rest


def _all_columns(run: Callable[[SparkSession, DataFrame], DataFrame], name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, feature_matrix(120)(spark, sf_dir)).select("feature", F.coalesce(F.round(name, 6) + 0.0, F.lit(-9.0)).alias(name))


Q["entropies"] = _all_columns(lambda _, m: stats.entropies(m, _ALL), "entropy")
SQL["entropies"] = _sql_long(" SELECT feature, round(entropy(v), 6) + 0.0 AS entropy FROM u GROUP BY feature")
Q["spearmans"] = _all_columns(lambda spark, m: stats.spearmans(spark, m, _ALL, _Y), "spearman")
SQL["spearmans"] = _sql_long(
    """,
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM u),
g AS (SELECT feature, CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM k GROUP BY feature)
SELECT feature, coalesce(round(rho, 6) + 0.0, -9.0) AS spearman FROM g"""
)
Q["ks_statistics"] = _all_columns(lambda spark, m: stats.ks_statistics(spark, m.where("trade_side > 0"), m.where("trade_side < 0"), _ALL), "ks")
SQL["ks_statistics"] = _sql_long(
    """,
d AS (SELECT u.feature, u.v, m.trade_side > 0 AS buys FROM u JOIN m USING (seq)),
e AS (SELECT feature, v, sum(count(*) FILTER (buys)) OVER w AS ca, sum(count(*) FILTER (NOT buys)) OVER w AS cb FROM d GROUP BY feature, v WINDOW w AS (PARTITION BY feature ORDER BY v))
SELECT feature, round(max(abs(ca / (SELECT count(*) FROM m WHERE trade_side > 0) - cb / (SELECT count(*) FROM m WHERE trade_side < 0))), 6) + 0.0 AS ks FROM e GROUP BY feature"""
)

# the time of day, moved by the price, against the price: all pairs in SQL, and harmonic sums for psi (its constant cancels out)
Q["mutual_information_neighbours"] = _stat("mutual_information", lambda _, t: neighbours.neighbour_information(t.select((F.col("timestamp") % DAY + F.col("price") * HOUR).alias("time"), "price"), "time", "price"))
SQL["mutual_information_neighbours"] = (
    _sql_tables()
    + f""",
v AS (SELECT row_number() OVER () AS i, (ts % {DAY})::DOUBLE + px * {HOUR} AS x, px AS y FROM t0),
s AS (SELECT stddev_pop(x)::FLOAT::DOUBLE AS sx, stddev_pop(y)::FLOAT::DOUBLE AS sy, min(x)::FLOAT::DOUBLE AS mx, min(y)::FLOAT::DOUBLE AS my FROM v),
p AS MATERIALIZED (SELECT i, CAST(round((x - mx) / sx * 4294967296) AS BIGINT) AS x, CAST(round((y - my) / sy * 4294967296) AS BIGINT) AS y FROM v, s),
r AS MATERIALIZED (SELECT a.i, a.x, a.y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] AS r FROM p a JOIN p b ON a.i <> b.i GROUP BY a.i, a.x, a.y),
near AS (
  SELECT r.i, r.r, count(*) FILTER (p.x = r.x AND p.y = r.y) AS n, count(*) FILTER (abs(p.x - r.x) < greatest(r.r, 1)) AS nx, count(*) FILTER (abs(p.y - r.y) < greatest(r.r, 1)) AS ny
  FROM r, p GROUP BY r.i, r.r),
h AS (SELECT m, coalesce(sum(1.0::DOUBLE / (m - 1)) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS psi FROM (SELECT unnest(range(2, (SELECT count(*) + 1 FROM p))) AS m) UNION ALL SELECT 1, 0.0),
f AS (SELECT avg(a.psi - b.psi - d.psi) AS part FROM near JOIN h a ON a.m = CASE WHEN r = 0 THEN n ELSE 3 END JOIN h b ON b.m = nx JOIN h d ON d.m = ny)
SELECT round(greatest(part + (SELECT psi FROM h WHERE m = (SELECT count(*) FROM p)), 0), 6) AS mutual_information FROM f"""
)


# --- models ------------------------------------------------------------------------------------------

_MODEL_SPECS = [Spec("spread", "spread_bps"), Spec("flow", "flow_imbalance", W6), Spec("liq", "feed_strength", W6, "first_feed"), Spec("side", "trade_side")]


def _trained(spark: SparkSession, sf_dir: str) -> training.ModelPipeline:
    found = catalog(spark, sf_dir)
    cat = Catalog(found.tables, 10 * DAY, "us", lookback={k: 2 * DAY for k in found.lookback_us}, lookahead={"quotes": DAY})
    model = training.build_model("residual_boosting", "regression", [s.name for s in _MODEL_SPECS], trees_per_call=2, max_depth=3)
    pipeline = training.ModelPipeline(
        model, _MODEL_SPECS, cat, labels.target(H4), sample_weight(F.col("price"), F.col("amount")), lambda state: labels.with_pnl(state, [H4]), (H4,)
    )
    pipeline.fit(log=lambda _: None)
    return pipeline


def boosted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir).predictions(F.col(f"pnl_{H4}"), F.col(f"valid_{H4}"))


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir).model.importances(spark)


Q["boosted_predictions"] = boosted_predictions
Q["feature_importance"] = feature_importance
