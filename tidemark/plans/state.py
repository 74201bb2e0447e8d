"""What every trade sees of the other tables, in one shuffle.

Rows of all sources and trades meet in one union, hash-partitioned by chunk and ordered by timestamp.
Growing frames over it give, for each trade at t, the rows up to t (closed), before t - w, and up to
t + horizon; differences of two growing frames are the closed window [t - w, t]. The last quote of a
frame is the greatest by (timestamp, seq), so any number of rows may share a timestamp. A window costs
no join and no sliding frame, and the number of windows does not change the shuffle.

A chunk is one task: its length bounds the rows of a task, and rows are spilled to disk as needed. ``carried_state`` gives the
same columns with a chunk's rows over any number of tasks, for chunks that are too busy for one.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import mid, notional, side_sign
from tidemark.sources.scratch import written

QUOTE_FIELDS = ["timestamp", "bid_price", "bid_amount", "ask_price", "ask_amount"]


@dataclass(frozen=True)
class Feed:
    """A liquidation table (with chunk_id) whose rows count ``shift_us`` after their timestamp."""

    table: DataFrame
    shift_us: int = 0


def market_state(
    trades: DataFrame,
    quotes: DataFrame | None = None,
    feeds: Mapping[str, Feed] | None = None,
    quote_windows: Iterable[int] = (),
    feed_windows: Iterable[int] = (),
    flow_windows: Iterable[int] = (),
    horizons: Iterable[int] = (),
) -> DataFrame:
    """The trades with their state; all tables have chunk_id, timestamp and seq, windows and horizons are microseconds.

    Columns: sign, notional; q (the quote at t, a struct), q_n, q_mid, q_ofi (sums up to t), q_past_w (the
    last quote before t - w), q_n_w, q_mid_w, q_ofi_w (sums over [t - w, t]), q_exit_h (the quote at t + h),
    q_last (the chunk's last quote timestamp); for each feed f_n_w, f_buy_w, f_sell_w, f_ts_w (the last
    row's shifted timestamp); flow_buy_w, flow_sell_w, flow_n_w of trades up to this one.
    """
    feeds = feeds or {}
    quote_windows, feed_windows, flow_windows, horizons = (sorted(set(x)) for x in (quote_windows, feed_windows, flow_windows, horizons))
    fields = trades.columns
    own = trades.select("chunk_id", "timestamp", "seq", F.lit("trade").alias("kind"), F.struct(*fields).alias("trade"))
    rows = _with_sources(own, quotes, feeds)
    # one exchange: the windows below are all partitioned by chunk_id or finer
    rows = rows.repartition("chunk_id")
    by_time = Window.partitionBy("chunk_id").orderBy("timestamp")

    def upto(us: int) -> Window:
        return by_time.rangeBetween(Window.unboundedPreceding, us)

    now, out = upto(0), {}
    if quotes is not None:
        before = F.last("quote", ignorenulls=True).over(Window.partitionBy("chunk_id").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("ofi", F.when(F.col("quote").isNotNull(), _flow_step(F.col("quote"), before)))
        middle = mid(F.col("quote.bid_price"), F.col("quote.ask_price"))
        sums = {"n": F.count("quote"), "mid": F.sum(middle), "ofi": F.sum("ofi")}
        out["q"] = F.max("quote").over(now)
        out["q_last"] = F.max("quote.timestamp").over(Window.partitionBy("chunk_id"))
        for w in quote_windows:
            past = upto(-(w + 1))
            out[f"q_past_{w}"] = F.max("quote").over(past)
            for what, total in sums.items():
                out[f"q_{what}_{w}"] = _difference(total, now, past)
        for h in horizons:
            out[f"q_exit_{h}"] = F.max("quote").over(upto(h))
    for name in feeds:
        at = f"feed_{name}"
        for w in feed_windows:
            past = upto(-(w + 1))
            for what, total in {"n": F.count(at), "buy": F.sum(f"{at}.buy"), "sell": F.sum(f"{at}.sell")}.items():
                out[f"{name}_{what}_{w}"] = _difference(total, now, past)
        out[f"{name}_ts"] = F.max(F.when(F.col(at).isNotNull(), F.col("timestamp"))).over(now)
    state = rows.withColumns(out) if out else rows
    state = state.where("kind = 'trade'").select("chunk_id", *(F.col(f"trade.{c}").alias(c) for c in fields if c != "chunk_id"), *out)
    sign = side_sign(F.col("side"), trades.schema["side"].dataType)
    state = state.withColumns({"sign": sign, "notional": notional(F.col("price").cast("double"), F.col("amount").cast("double"))})
    # trades up to this row, also among equal timestamps, less those before t - w
    own = Window.partitionBy("chunk_id").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, 0)
    flow = {}
    for w in flow_windows:
        past = Window.partitionBy("chunk_id").orderBy("timestamp").rangeBetween(Window.unboundedPreceding, -(w + 1))
        flow[f"flow_buy_{w}"] = _difference(F.sum(F.when(F.col("sign") > 0, F.col("notional")).otherwise(0.0)), own, past)
        flow[f"flow_sell_{w}"] = _difference(F.sum(F.when(F.col("sign") < 0, F.col("notional")).otherwise(0.0)), own, past)
        flow[f"flow_n_{w}"] = _difference(F.count(F.lit(1)), own, past)
    return state.withColumns(flow) if flow else state


def _with_sources(rows: DataFrame, quotes: DataFrame | None, feeds: Mapping[str, Feed]) -> DataFrame:
    """``rows`` and those of quotes (column ``quote``) and of feeds (``feed_name``, at their shifted timestamps)."""
    if quotes is not None:
        rows = rows.unionByName(
            quotes.select(
                "chunk_id",
                "timestamp",
                "seq",
                F.lit("quote").alias("kind"),
                F.struct(F.col("timestamp"), F.col("seq"), *(F.col(c).cast("double").alias(c) for c in QUOTE_FIELDS[1:])).alias("quote"),
            ),
            allowMissingColumns=True,
        )
    for name, feed in feeds.items():
        value = notional(F.col("price"), F.col("amount"))
        rows = rows.unionByName(
            feed.table.select(
                "chunk_id",
                (F.col("timestamp") + F.lit(feed.shift_us)).alias("timestamp"),
                "seq",
                F.lit(name).alias("kind"),
                F.struct(
                    F.when(F.col("side") == "buy", value).otherwise(0.0).alias("buy"),
                    F.when(F.col("side") == "sell", value).otherwise(0.0).alias("sell"),
                ).alias(f"feed_{name}"),
            ),
            allowMissingColumns=True,
        )
    return rows


def _difference(total, now, past):
    return F.coalesce(total.over(now), F.lit(0)) - F.coalesce(total.over(past), F.lit(0))


def _flow_step(q, p):
    """What a quote adds to order-flow imbalance: the first of a chunk its amounts' difference, later ones by price moves."""
    bid = F.when(q["bid_price"] > p["bid_price"], q["bid_amount"]).when(q["bid_price"] == p["bid_price"], q["bid_amount"] - p["bid_amount"]).otherwise(-p["bid_amount"])
    ask = F.when(q["ask_price"] < p["ask_price"], q["ask_amount"]).when(q["ask_price"] == p["ask_price"], q["ask_amount"] - p["ask_amount"]).otherwise(-p["ask_amount"])
    return F.when(p.isNull(), q["bid_amount"] - q["ask_amount"]).otherwise(bid - ask)


def carried_state(
    trades: DataFrame,
    quotes: DataFrame | None = None,
    feeds: Mapping[str, Feed] | None = None,
    quote_windows: Iterable[int] = (),
    feed_windows: Iterable[int] = (),
    flow_windows: Iterable[int] = (),
    horizons: Iterable[int] = (),
    partitions: int | None = None,
) -> DataFrame:
    """As ``market_state``, with the rows in ``partitions`` ranges of (chunk, time) instead of a task for each chunk.

    Each trade asks at t, before t - w and at t + h by a row of its own, which stands behind all rows of its time. Last quotes and sums run
    within each range; what a range adds to them is one row for each chunk that it meets (its first and last quote, and sums), and these rows
    in order give what each range starts from. The order-flow step of a range's first quote is taken there, as it needs the last quote
    of an earlier range. The answers meet at their trade in a second exchange.
    """
    feeds = feeds or {}
    quote_windows, feed_windows, flow_windows, horizons = (sorted(set(x)) for x in (quote_windows, feed_windows, flow_windows, horizons))
    spark, fields = trades.sparkSession, trades.columns
    sign = side_sign(F.col("side"), trades.schema["side"].dataType)
    own = trades.withColumns({"sign": sign, "notional": notional(F.col("price").cast("double"), F.col("amount").cast("double"))})
    own = own.select("chunk_id", "timestamp", "seq", F.monotonically_increasing_id().alias("trade_id"), F.struct(*fields, "sign", "notional").alias("trade"))
    asks = sorted({0} | {-(w + 1) for w in (*quote_windows, *feed_windows, *flow_windows)} | set(horizons))
    # the trade itself (ask null), then what it asks
    probes = [F.struct(F.col("timestamp").alias("at"), F.lit(0).alias("tie"), F.lit(None).cast("long").alias("ask"), F.col("trade").alias("trade"))]
    probes += [F.struct((F.col("timestamp") + F.lit(a)).alias("at"), F.lit(1).alias("tie"), F.lit(a).cast("long").alias("ask"), F.lit(None).cast(own.schema["trade"].dataType).alias("trade")) for a in asks]
    rows = own.select("chunk_id", "seq", "trade_id", F.explode(F.array(*probes)).alias("p")).select("chunk_id", F.col("p.at").alias("timestamp"), "p.tie", "seq", "trade_id", "p.ask", "p.trade", F.lit("trade").alias("kind"))
    rows = _with_sources(rows, quotes, feeds).withColumn("tie", F.coalesce("tie", F.lit(0)))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(n, "chunk_id", "timestamp", "tie", "seq").withColumn("_part", F.spark_partition_id()), spark)

    # what every row adds, and how each range adds it up: by sums, the latest of times, and the last quote
    adds = {}
    if quotes is not None:
        before = F.last("quote", ignorenulls=True).over(Window.partitionBy("_part", "chunk_id").orderBy("timestamp", "tie", "seq").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_before", before)
        adds |= {"n": F.when(F.col("quote").isNotNull(), 1).otherwise(0), "mid": mid(F.col("quote.bid_price"), F.col("quote.ask_price"))}
        adds["ofi"] = F.when(F.col("quote").isNotNull() & F.col("_before").isNotNull(), _flow_step(F.col("quote"), F.col("_before")))
    for name in feeds:
        at = f"feed_{name}"
        adds |= {f"{name}_n": F.when(F.col(at).isNotNull(), 1).otherwise(0), f"{name}_buy": F.col(f"{at}.buy"), f"{name}_sell": F.col(f"{at}.sell")}
    if flow_windows:
        value, side = F.col("trade.notional"), F.col("trade.sign")
        adds |= {"flow_n": F.when(F.col("trade").isNotNull(), 1).otherwise(0), "flow_buy": F.when(side > 0, value), "flow_sell": F.when(side < 0, value)}
    latest = {f"{name}_ts": F.when(F.col(f"feed_{name}").isNotNull(), F.col("timestamp")) for name in feeds}
    rows = rows.withColumns({f"a_{k}": F.coalesce(v, F.lit(0)) for k, v in adds.items()} | {f"a_{k}": v for k, v in latest.items()})

    order = Window.partitionBy("chunk_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(f"a_{k}").alias(f"s_{k}") for k in adds] + [F.max(f"a_{k}").alias(f"s_{k}") for k in latest]
    if quotes is not None:
        whole += [F.min("quote").alias("first_quote"), F.max("quote").alias("last_quote")]
    ranges = rows.groupBy("_part", "chunk_id").agg(*(whole or [F.count("*").alias("rows")]))
    start = {f"c_{k}": F.coalesce(F.sum(f"s_{k}").over(order), F.lit(0)) for k in adds if k != "ofi"} | {f"c_{k}": F.max(f"s_{k}").over(order) for k in latest}
    if quotes is not None:
        start |= {"c_quote": F.max("last_quote").over(order), "q_last": F.max("last_quote.timestamp").over(Window.partitionBy("chunk_id"))}
        ranges = ranges.withColumns(start).withColumn("step", F.when(F.col("first_quote").isNotNull(), _flow_step(F.col("first_quote"), F.col("c_quote"))).otherwise(0.0))
        start = {"c_ofi": F.coalesce(F.sum(F.col("s_ofi") + F.col("step")).over(order), F.lit(0.0))}
    ranges = ranges.withColumns(start) if start else ranges
    kept = [c for c in ranges.columns if c.startswith("c_") and c != "chunk_id" or c in ("step", "q_last")]

    upto = Window.partitionBy("_part", "chunk_id").orderBy("timestamp", "tie", "seq").rowsBetween(Window.unboundedPreceding, 0)
    local = {f"l_{k}": F.sum(f"a_{k}").over(upto) for k in adds} | {f"l_{k}": F.max(f"a_{k}").over(upto) for k in latest}
    if quotes is not None:
        local["l_quote"] = F.last("quote", ignorenulls=True).over(upto)
    seen = rows.withColumns(local) if local else rows
    seen = seen.where("kind = 'trade'").join(ranges.select("_part", "chunk_id", *kept), ["_part", "chunk_id"])
    now = {k: F.col(f"l_{k}") + F.col(f"c_{k}") for k in adds} | {k: F.greatest(f"l_{k}", f"c_{k}") for k in latest}
    if quotes is not None:
        now["ofi"] = now["ofi"] + F.when(F.col("l_n") > 0, F.col("step")).otherwise(0.0)
        now["quote"] = F.coalesce("l_quote", "c_quote")
    seen = seen.select("trade_id", "ask", "trade", F.struct(F.lit(True).alias("asked"), *(v.alias(k) for k, v in now.items())).alias("state"), *(["q_last"] if quotes is not None else []))

    met = [F.max("trade").alias("trade"), *(F.max(F.when(F.col("ask") == a, F.col("state"))).alias(f"at_{i}") for i, a in enumerate(asks)), F.max(F.when(F.col("ask").isNull(), F.col("state"))).alias("own")]
    if quotes is not None:
        met.append(F.max("q_last").alias("q_last"))
    met = seen.groupBy("trade_id").agg(*met)

    def state(ask: int, what: str):
        return F.col(f"at_{asks.index(ask)}.{what}")

    out = {}
    if quotes is not None:
        out |= {"q": state(0, "quote"), "q_last": F.col("q_last")}
        for w in quote_windows:
            out[f"q_past_{w}"] = state(-(w + 1), "quote")
            out |= {f"q_{what}_{w}": state(0, what) - state(-(w + 1), what) for what in ("n", "mid", "ofi")}
        out |= {f"q_exit_{h}": state(h, "quote") for h in horizons}
    for name in feeds:
        for w in feed_windows:
            out |= {f"{name}_{what}_{w}": state(0, f"{name}_{what}") - state(-(w + 1), f"{name}_{what}") for what in ("n", "buy", "sell")}
        out[f"{name}_ts"] = state(0, f"{name}_ts")
    for w in flow_windows:
        out |= {f"flow_{what}_{w}": F.col(f"own.flow_{what}") - state(-(w + 1), f"flow_{what}") for what in ("buy", "sell", "n")}
    return met.select(*(F.col(f"trade.{c}").alias(c) for c in [*fields, "sign", "notional"]), *(v.alias(k) for k, v in out.items()))
