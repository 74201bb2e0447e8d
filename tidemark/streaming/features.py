"""Features on a stream, equal to those over the whole tables wherever micro-batches are cut.

One stream carries the rows of all tables, told apart by ``kind``. What later rows can still see of earlier ones is a tail: the rows of
the longest window, and the last quote before it. Each batch's trades get their features over the tail and the batch, and
leave the next tail below the checkpoint, under the batch's number. So a tail does not grow with the stream, and a batch that is repeated
after a failure starts from the same tail as before.

Batches come in order of time: a row that is not newer than the newest one before its batch is late. Late trades get features over what
the tail still holds; late rows of other tables count for trades of later batches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.features import Spec
from tidemark.plans.specs import SECOND_FEED_DELAY_US, feature_table, state_of
from tidemark.sources import sinks

_FIELDS = {"trades": ["side", "price", "amount"], "quotes": ["bid_price", "bid_amount", "ask_price", "ask_amount"]}
_KINDS = {"side": T.StringType(), **{c: T.DoubleType() for c in ("price", "amount", "bid_price", "bid_amount", "ask_price", "ask_amount")}}


def one_stream(tables: Mapping[str, DataFrame]) -> DataFrame:
    """kind, timestamp, seq and the columns of all tables (trades, quotes, and feeds by name), as one DataFrame or stream."""
    out = None
    for name, df in tables.items():
        own = _FIELDS.get(name, _FIELDS["trades"])
        one = df.select(F.lit(name).alias("kind"), "timestamp", "seq", *((F.col(c) if c in own else F.lit(None)).cast(t).alias(c) for c, t in _KINDS.items()))
        out = one if out is None else out.unionByName(one)
    return out


def batch_features(rows: DataFrame, specs: list[Spec], delays: Mapping[str, int]) -> DataFrame:
    """timestamp, seq and features of the fresh trades of ``rows`` (as of ``one_stream``, with fresh)."""
    feeds = {s.feed for s in specs if s.feed}

    def table(name: str) -> DataFrame:
        own = _FIELDS.get(name, _FIELDS["trades"])
        return rows.where(F.col("kind") == name).select(F.lit(0).cast("long").alias("chunk_id"), "timestamp", "seq", *own, "fresh")

    state = state_of({name: table(name) for name in ("trades", "quotes", *feeds)}, specs, delays=delays)
    return feature_table(state.where("fresh"), specs)


def next_tail(rows: DataFrame, specs: list[Spec], delays: Mapping[str, int]) -> DataFrame:
    """What of ``rows`` the trades of later batches can see."""
    reach = max([s.window_us for s in specs], default=0) + max([*delays.values(), 0])
    newest = rows.agg(F.max("timestamp").alias("newest"))
    seen = rows.crossJoin(F.broadcast(newest))  # one row
    recent = seen.where(F.col("timestamp") >= F.col("newest") - reach - 1).drop("newest")
    columns = [c for c in rows.columns if c != "fresh"]
    older = seen.where((F.col("kind") == "quotes") & (F.col("timestamp") < F.col("newest") - reach - 1)).agg(F.max(F.struct("timestamp", "seq", *(c for c in columns if c not in ("timestamp", "seq")))).alias("last"))
    return recent.select(*columns).unionByName(older.where("last is not null").select(*(F.col(f"last.{c}").alias(c) for c in columns)))


def features_on_stream(rows: DataFrame, specs: list[Spec], sink: Callable[[DataFrame, int], None], checkpoint: str, delays: Mapping[str, int] | None = None) -> StreamingQuery:
    """Hands the features of each micro-batch's trades to ``sink`` with the batch's number; a repeated batch has the same number and rows.

    ``rows`` as of ``one_stream``. Tails older than the one before the last are removed.
    """
    delays = {"second_feed": SECOND_FEED_DELAY_US} if delays is None else delays
    spark, folder = rows.sparkSession, f"{checkpoint}/tails"

    def step(batch: DataFrame, epoch: int) -> None:
        whole = [name for name in sinks.file_names(spark, folder) if name.isdigit() and int(name) < epoch and "_SUCCESS" in sinks.file_names(spark, f"{folder}/{name}")]
        every = batch.withColumn("fresh", F.lit(True))
        if whole:
            tail = spark.read.schema(batch.schema).parquet(f"{folder}/{whole[-1]}")
            every = every.unionByName(tail.withColumn("fresh", F.lit(False)))
        every = every.persist()
        try:
            next_tail(every, specs, delays).write.mode("overwrite").parquet(f"{folder}/{epoch:012d}")
            sink(batch_features(every, specs, delays), epoch)
        finally:
            every.unpersist()
        for name in whole[:-1]:
            sinks.remove(spark, f"{folder}/{name}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
