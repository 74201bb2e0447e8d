"""Feature sets: which features over which windows for a horizon, and the table that holds them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import SECOND
from tidemark.operators.features import FEATURES, FEED, QUOTE, TRADE, Spec
from tidemark.plans.state import Feed, carried_state, market_state
from tidemark.sources.catalog import LIQUIDATIONS, QUOTES, TRADES, Catalog, Source, sources

HORIZONS_SEC = (30, 120, 300)
LOOKBACK_SEC, LOOKAHEAD_SEC = 301, 300
SECOND_FEED_DELAY_US = 200_000

# Windows in seconds for each horizon.
WINDOWS = {
    30: {"short": 15, "long": 30, "delta": (5, 15), "ofi": (5, 15), "ofi_long": 30, "flow": (5, 15), "amount": (15, 30)},
    120: {"short": 30, "long": 120, "delta": (15, 60), "ofi": (15, 60), "ofi_long": 120, "flow": (15, 60), "amount": (60, 120)},
    300: {"short": 30, "long": 300, "delta": (30, 120), "ofi": (30, 120), "ofi_long": 300, "flow": (30, 120), "amount": (120, 300)},
}

# The tables of a data folder.
PATHS = {"quotes": "quotes", "trades": "trades", "first_feed": "liquidations_first", "second_feed": "liquidations_second"}
# Fixed value: the experiments' names.
EXPERIMENTS = ("core",)


def feature_specs(horizon_sec: int, scale: int = SECOND, first: str = "binance_liq", second: str = "bybit_liq") -> list[Spec]:
    """The 36 columns of a horizon, in order. ``scale`` is the length of a window's second in microseconds."""
    if horizon_sec not in WINDOWS:
        raise ValueError(f"unknown horizon: {horizon_sec}")
    v = WINDOWS[horizon_sec]
    s, h, d, o, f, a = v["short"], v["long"], v["delta"], v["ofi"], v["flow"], v["amount"]

    def over(name: str, feature: str, *seconds: int, feed: str | None = None) -> list[Spec]:
        return [Spec(f"{name}_{x}s", feature, x * scale, feed) for x in seconds]

    ofi = (("bbo_ofi", "order_flow_imbalance"), ("bbo_ofi_norm", "order_flow_imbalance_norm"))
    # The columns' names and their order.
    return [
        Spec("trade_side", "trade_side"),
        Spec("trade_signed_notional_log", "trade_signed_notional_log"),
        Spec("bbo_spread_bps", "spread_bps"),
        Spec("bbo_top_depth_log", "top_depth_log"),
        *over("bbo_vol_imb", "volume_imbalance", s, h),
        *over("bbo_depth_imb_value", "depth_imbalance_value", s, h),
        *over("bbo_microprice_premium", "micro_price_premium_bps", s, h),
        *over("trade_bbo_edge", "edge_bps", s, h),
        *over("bbo_mid_smooth_delta", "mid_smooth_delta_bps", s, h),
        *over("bbo_mid_delta_bps", "mid_delta_bps", *d),
        *(x for w in o for name, feature in ofi for x in over(name, feature, w)),
        *over("bbo_ofi", "order_flow_imbalance", v["ofi_long"]),
        *over("trade_flow_imbalance", "flow_imbalance", *f),
        *over("trade_flow_toxicity", "flow_toxicity", *f),
        *over("trade_flow_notional_log", "flow_notional_log", *a),
        *over("trade_flow_count_log", "flow_count_log", *a),
        *over(f"{first}_strength", "feed_strength", s, h, feed="first_feed"),
        *over(f"{first}_total_notional", "feed_total_notional_log", h, feed="first_feed"),
        *over(f"trade_side_{first}_strength", "side_feed_strength", h, feed="first_feed"),
        *over(f"{second}_strength", "feed_strength", s, h, feed="second_feed"),
        *over(f"{second}_total_notional", "feed_total_notional_log", h, feed="second_feed"),
    ]


def data_sources(root: str) -> list[Source]:
    """The four tables below ``root``."""
    kinds = {"quotes": QUOTES, "trades": TRADES, "first_feed": LIQUIDATIONS, "second_feed": LIQUIDATIONS}
    return sources(root, PATHS, kinds)


def first_existing(spark, candidates: list[str]) -> str:
    """The first of ``candidates`` that holds files, in any store; FileNotFoundError if none does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in candidates:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            return path
    raise FileNotFoundError(f"none of {candidates}")


def market_catalog(tables: Mapping[str, DataFrame], chunk_sec: float = 3600, since: int | None = None, until: int | None = None, bounds: Mapping[str, tuple[int | None, int | None]] | None = None) -> Catalog:
    """The catalog with the default lookback and lookahead: quotes both, feeds lookback, trades neither. ``bounds`` as of ``Catalog``."""
    back = {name: LOOKBACK_SEC for name in tables if name != "trades"}
    return Catalog(tables, chunk_sec, "sec", since, until, back, {"quotes": LOOKAHEAD_SEC} if "quotes" in tables else {}, bounds)


def state_for(catalog: Catalog, specs: list[Spec], horizons_us: tuple[int, ...] = (), chunked: bool = True, delays: Mapping[str, int] | None = None, tables: Mapping[str, DataFrame] | None = None, partitions: int | None = None) -> DataFrame:
    """The market state that ``specs`` and ``horizons_us`` need.

    ``chunked``: windows and look-ups see what their time chunk sees; otherwise the whole tables are one chunk
    (for small data). ``tables`` are chunked tables to use instead, such as those of one chunk.
    With ``partitions`` the rows are dealt over so many tasks, whatever the chunks; without, a chunk is one task.
    """
    read = (tables.__getitem__) if tables is not None else catalog.chunked if chunked else catalog.whole
    quotes = horizons_us or any(FEATURES[s.feature].source == QUOTE for s in specs)
    needed = ["trades", *(["quotes"] if quotes else []), *sorted({s.feed for s in specs if s.feed})]
    return state_of({name: read(name) for name in needed}, specs, horizons_us, delays, partitions)


def state_of(tables: Mapping[str, DataFrame], specs: list[Spec], horizons_us: tuple[int, ...] = (), delays: Mapping[str, int] | None = None, partitions: int | None = None) -> DataFrame:
    """The market state that ``specs`` and ``horizons_us`` need of tables with chunk_id: trades, quotes, and feeds by name."""
    delays = {"second_feed": SECOND_FEED_DELAY_US} if delays is None else delays
    by = {kind: {s.window_us for s in specs if FEATURES[s.feature].source == kind and FEATURES[s.feature].windowed} for kind in (QUOTE, TRADE, FEED)}
    made = market_state if partitions is None else partial(carried_state, partitions=partitions)
    return made(
        tables["trades"],
        tables.get("quotes"),
        {name: Feed(tables[name], delays.get(name, 0)) for name in sorted({s.feed for s in specs if s.feed})},
        by[QUOTE],
        by[FEED],
        by[TRADE],
        horizons_us,
    )


def feature_table(state: DataFrame, specs: list[Spec], narrow: bool = True, keep: tuple[str, ...] = ("timestamp", "seq"), max_used: bool = False) -> DataFrame:
    """``keep`` and the columns of ``specs``; with ``max_used`` also the latest timestamp that each depends on."""
    used = [s.max_used() for s in specs] if max_used else []
    return state.select(*keep, *(s.column(narrow) for s in specs), *used)
