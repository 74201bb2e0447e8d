"""What a trade earned at each horizon, and averages of it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import ieee_divide, label_weight, mid, side_sign_lenient

REBATE_BPS = 0.5


def horizon_index(horizons: Iterable[int], horizon: int) -> int:
    """The place of a horizon; an unknown one raises ValueError."""
    return list(horizons).index(horizon)


def with_pnl(state: DataFrame, horizons_us: Iterable[int], rebate_bps: float = REBATE_BPS) -> DataFrame:
    """``state`` with pnl_h (null if not valid), valid_h and weight.

    Valid: some quote is known at t + h, and the last quote the chunk sees is not earlier than t + h. A
    chunk without quotes has no valid labels.
    """
    sign = side_sign_lenient(F.col("side"), state.schema["side"].dataType)
    price = F.col("price").cast("double")
    out: dict[str, Column] = {"weight": label_weight(price, F.col("amount").cast("double"))}
    for h in horizons_us:
        exit_quote = f"q_exit_{h}"
        valid = F.col(exit_quote).isNotNull() & F.coalesce(F.col("timestamp") + h <= F.col("q_last"), F.lit(False))
        change = ieee_divide(mid(F.col(f"{exit_quote}.bid_price"), F.col(f"{exit_quote}.ask_price")) - price, price)
        out[f"valid_{h}"] = valid
        out[f"pnl_{h}"] = F.when(valid, -sign * change * 10_000.0 + rebate_bps)
    return state.withColumns(out)


def marks(labelled: DataFrame, horizons_us: Iterable[int]) -> dict[str, Column]:
    """1 for valid trades that earned nothing or lost, else 0, as a byte."""
    return {f"mark_{h}": F.when(F.col(f"valid_{h}") & (F.col(f"pnl_{h}") <= 0), 1).otherwise(0).cast("byte") for h in horizons_us}


def target(h: int) -> Column:
    """The regression target: badness, null where not valid."""
    return (-F.col(f"pnl_{h}")).cast("float")


def _mean(pnl: Column, weight: Column, use: Column) -> Column:
    total = F.sum(F.when(use, weight))
    return F.when(total > 0, F.sum(F.when(use, weight * pnl)) / F.nullif(total, F.lit(0.0)))


def averages(labelled: DataFrame, horizons_us: Iterable[int], filtered: dict[int, Column] | None = None) -> DataFrame:
    """horizon, pnl_all, pnl_kept, pnl_filtered, score = kept - all; weighted, null without weight.

    ``filtered``: for each horizon the trades that are filtered out; none by default. One pass over the rows.
    """
    horizons = list(horizons_us)
    aggs = []
    for h in horizons:
        out = (filtered or {}).get(h, F.lit(False))
        valid, pnl = F.col(f"valid_{h}"), F.col(f"pnl_{h}")
        aggs += [
            _mean(pnl, F.col("weight"), valid).alias(f"all_{h}"),
            _mean(pnl, F.col("weight"), valid & ~out).alias(f"kept_{h}"),
            _mean(pnl, F.col("weight"), valid & out).alias(f"filtered_{h}"),
        ]
    one = labelled.agg(*aggs)
    rows = [F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"all_{h}").alias("pnl_all"), F.col(f"kept_{h}").alias("pnl_kept"), F.col(f"filtered_{h}").alias("pnl_filtered")) for h in horizons]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*", (F.col("r.pnl_kept") - F.col("r.pnl_all")).alias("score"))
