"""Streams of trades: tumbling flow with late data bounded, and models grown by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.exprs import notional, side_sign
from tidemark.operators.boosting import HistogramBooster
from tidemark.operators.training import grow
from tidemark.sources import sinks


def flow_per_window(trades: DataFrame, seconds: int, late_seconds: int = 60) -> DataFrame:
    """start (microseconds), buy, sell, n of tumbling windows; trades later than ``late_seconds`` are left out."""
    sign = side_sign(F.col("side"), trades.schema["side"].dataType)
    value = notional(F.col("price"), F.col("amount"))
    return (
        trades.withColumn("at", F.timestamp_micros("timestamp"))
        .withWatermark("at", f"{late_seconds} seconds")
        .groupBy(F.window("at", f"{seconds} seconds").alias("w"))
        .agg(F.sum(F.when(sign > 0, value).otherwise(0.0)).alias("buy"), F.sum(F.when(sign < 0, value).otherwise(0.0)).alias("sell"), F.count("*").alias("n"))
        .select(F.unix_micros("w.start").alias("start"), "buy", "sell", "n")
    )


def train_on_stream(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], model, checkpoint: str) -> StreamingQuery:
    """Grows ``model`` by every non-empty micro-batch of prepared rows. A batch that is repeated after a failure trains once.

    A model that can be saved leaves, after each batch, what the batch has added, with the batch's number below ``checkpoint``; a stream
    that starts again from there goes on with all parts that were saved whole. Other models remember their batches while the process lives.
    """
    spark, folder = rows.sparkSession, f"{checkpoint}/models"
    keeps = isinstance(model, HistogramBooster)
    done = -1
    if keeps:
        parts = [f"{folder}/{name}" for name in sinks.file_names(spark, folder) if "_SUCCESS" in sinks.file_names(spark, f"{folder}/{name}/metadata")]
        if parts:
            saved = HistogramBooster.load(spark, *parts)
            model.trees, model.start, model.epoch = saved.trees, saved.start, saved.epoch
            done = saved.epoch

    def step(batch: DataFrame, epoch: int) -> None:
        nonlocal done
        if epoch <= done:
            return
        ready = prepare(batch).persist()
        since = len(model.trees) if keeps else 0
        try:
            some = grow(model, ready)
        finally:
            ready.unpersist()
        done = epoch
        if keeps and some:
            model.epoch = epoch
            model.save(spark, f"{folder}/{epoch:012d}", since)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
