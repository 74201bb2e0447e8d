"""Features of a trade as columns over its market state.

Each feature is a function (state columns named by window) -> Column in double precision;
``column`` narrows it to float as the last step. Products with the trade's sign are taken in float
where the definition narrows first (``in_float``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import ieee_divide, log1p, mid, over_nonzero, over_positive, signed_log

BPS = 10_000.0
QUOTE, TRADE, FEED = "quote", "trade", "feed"


def _q(field: str, at: str = "q") -> Column:
    return F.col(f"{at}.{field}")


def _mid(at: str = "q") -> Column:
    return mid(_q("bid_price", at), _q("ask_price", at))


def _with_quote(value: Column) -> Column:
    """0 without a quote."""
    return F.when(F.col("q").isNotNull(), value).otherwise(0.0)


def _depth() -> Column:
    return _q("bid_amount") + _q("ask_amount")


def _sides() -> tuple[Column, Column]:
    return _q("bid_price") * _q("bid_amount"), _q("ask_price") * _q("ask_amount")


def spread_bps(w: int) -> Column:
    return _with_quote(over_nonzero(_q("ask_price") - _q("bid_price"), _mid()) * BPS)


def volume_imbalance(w: int) -> Column:
    return _with_quote(over_positive(_q("bid_amount") - _q("ask_amount"), _depth()))


def volume_imbalance_abs(w: int) -> Column:
    return F.abs(volume_imbalance(w))


def mid_smooth_delta_bps(w: int) -> Column:
    mean = over_positive(F.col(f"q_mid_{w}"), F.col(f"q_n_{w}").cast("double"))
    value = over_nonzero(_mid() - mean, mean) * BPS
    return F.when(F.col("q").isNotNull() & (F.col(f"q_n_{w}") > 0), value).otherwise(0.0)


def top_depth_log(w: int) -> Column:
    bid, ask = _sides()
    return _with_quote(log1p(bid + ask))


def mid_delta_bps(w: int) -> Column:
    past = f"q_past_{w}"
    return F.when(F.col("q").isNotNull() & F.col(past).isNotNull(), over_nonzero(_mid() - _mid(past), _mid(past)) * BPS).otherwise(0.0)


def micro_price_premium_bps(w: int) -> Column:
    micro = over_positive(_q("ask_price") * _q("bid_amount") + _q("bid_price") * _q("ask_amount"), _depth(), _mid())
    return _with_quote(over_nonzero(micro - _mid(), _mid()) * BPS)


def edge_bps(w: int) -> Column:
    price = F.col("price").cast("double")
    return _with_quote(-F.col("sign") * ieee_divide(_mid() - price, price) * BPS)


def order_flow_imbalance(w: int) -> Column:
    return F.col(f"q_ofi_{w}").cast("double")


def order_flow_imbalance_norm(w: int) -> Column:
    return _with_quote(over_positive(order_flow_imbalance(w).cast("float").cast("double"), _depth()))


def depth_imbalance_value(w: int) -> Column:
    bid, ask = _sides()
    return _with_quote(over_positive(bid - ask, bid + ask))


def trade_side(w: int) -> Column:
    return F.col("sign")


def trade_notional_log(w: int) -> Column:
    return log1p(F.col("notional"))


def trade_signed_notional_log(w: int) -> Column:
    return F.col("sign") * log1p(F.col("notional"))


def _flow(w: int) -> tuple[Column, Column]:
    return F.col(f"flow_buy_{w}"), F.col(f"flow_sell_{w}")


def flow_imbalance(w: int) -> Column:
    buy, sell = _flow(w)
    return over_positive(buy - sell, buy + sell)


def side_flow_imbalance(w: int) -> Column:
    return F.col("sign") * flow_imbalance(w)


def flow_toxicity(w: int) -> Column:
    buy, sell = _flow(w)
    return over_positive(F.abs(buy - sell), buy + sell)


def flow_notional_log(w: int) -> Column:
    buy, sell = _flow(w)
    return log1p(buy + sell)


def flow_count_log(w: int) -> Column:
    return log1p(F.col(f"flow_n_{w}").cast("double"))


def _feed(w: int, name: str) -> tuple[Column, Column, Column]:
    return F.col(f"{name}_buy_{w}"), F.col(f"{name}_sell_{w}"), F.col(f"{name}_n_{w}").cast("double")


def feed_imbalance(w: int, name: str) -> Column:
    buy, sell, _ = _feed(w, name)
    return over_positive(buy - sell, buy + sell)


def feed_strength(w: int, name: str) -> Column:
    buy, sell, _ = _feed(w, name)
    return signed_log(buy - sell)


def feed_total_notional_log(w: int, name: str) -> Column:
    buy, sell, _ = _feed(w, name)
    return log1p(buy + sell)


def feed_count_log(w: int, name: str) -> Column:
    return log1p(_feed(w, name)[2])


def feed_mean_notional_log(w: int, name: str) -> Column:
    buy, sell, n = _feed(w, name)
    return log1p(over_positive(buy + sell, n))


@dataclass(frozen=True)
class Feature:
    """A registered definition: its source, whether its window matters, and what it multiplies by the trade's sign."""

    source: str
    define: Callable[..., Column]
    windowed: bool = False
    signed: bool = False


def _plain(source: str, windowed: bool, *defines: Callable[..., Column]) -> dict[str, Feature]:
    return {f.__name__: Feature(source, f, windowed) for f in defines}


FEATURES: dict[str, Feature] = {
    **_plain(QUOTE, False, spread_bps, volume_imbalance, volume_imbalance_abs, top_depth_log, micro_price_premium_bps, edge_bps, depth_imbalance_value),
    **_plain(QUOTE, True, mid_smooth_delta_bps, mid_delta_bps, order_flow_imbalance, order_flow_imbalance_norm),
    **_plain(TRADE, False, trade_side, trade_notional_log, trade_signed_notional_log),
    **_plain(TRADE, True, flow_imbalance, side_flow_imbalance, flow_toxicity, flow_notional_log, flow_count_log),
    **_plain(FEED, True, feed_imbalance, feed_strength, feed_total_notional_log, feed_count_log, feed_mean_notional_log),
    **{
        f"side_{f.__name__}": Feature(source, f, windowed, signed=True)
        for source, windowed, f in [
            (QUOTE, False, volume_imbalance),
            (QUOTE, False, micro_price_premium_bps),
            (QUOTE, True, mid_delta_bps),
            (QUOTE, True, mid_smooth_delta_bps),
            (QUOTE, True, order_flow_imbalance),
            (FEED, True, feed_imbalance),
            (FEED, True, feed_strength),
        ]
    },
}


def register(name: str, source: str, define: Callable[..., Column], windowed: bool = False) -> None:
    """Adds a definition of one's own; it may use any state column."""
    FEATURES[name] = Feature(source, define, windowed)


@dataclass(frozen=True)
class Spec:
    """One output column: a registered feature over a window (microseconds), for feeds with the feed's name."""

    name: str
    feature: str
    window_us: int = 0
    feed: str | None = None

    def column(self, narrow: bool = True) -> Column:
        made = FEATURES[self.feature]
        value = made.define(self.window_us, self.feed) if made.source == FEED else made.define(self.window_us)
        if made.signed:
            value = (value.cast("float") * F.col("sign").cast("float")) if narrow else value * F.col("sign")
        return (value.cast("float") if narrow else value).alias(self.name)

    def max_used(self) -> Column:
        """The latest timestamp the value depends on."""
        made, t = FEATURES[self.feature], F.col("timestamp")
        if made.source == TRADE:
            used = t
        elif made.source == FEED:
            used = F.when(F.col(f"{self.feed}_n_{self.window_us}") > 0, F.col(f"{self.feed}_ts")).otherwise(t)
        elif made.define in (mid_smooth_delta_bps, order_flow_imbalance, order_flow_imbalance_norm):
            used = F.when(F.col(f"q_n_{self.window_us}") > 0, _q("timestamp")).otherwise(t)
        else:
            used = F.coalesce(_q("timestamp"), t)
        return used.alias(f"mu_{self.name}")
