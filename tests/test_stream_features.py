"""Features on a stream against those over whole tables."""

import random

from pyspark.sql import functions as F

from tidemark.operators.features import Spec
from tidemark.plans.specs import feature_specs, feature_table, state_for
from tidemark.queries import SCALE, tables
from tidemark.sources import sinks
from tidemark.sources.catalog import Catalog
from tidemark.streaming.features import features_on_stream, next_tail, one_stream

SMALL = "/root/testdata/sf0.001"
SPECS = feature_specs(30, SCALE)


def test_batches_of_any_size_and_a_restart(spark, tmp_path):
    found = tables(spark, SMALL, bucketed=True)
    rows = one_stream(found).cache()
    times = sorted(r.timestamp for r in rows.select("timestamp").distinct().collect())
    rng = random.Random(2)
    cuts = [times[0], *sorted(rng.sample(times[1:], 5)), times[-1] + 1]
    got = {}

    def run(upto):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = features_on_stream(source, SPECS, lambda df, epoch: got.update({epoch: df.collect()}), f"{tmp_path}/state")
        query.processAllAvailable()
        query.stop()
        assert len(got) == upto

    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        rows.where((F.col("timestamp") >= a) & (F.col("timestamp") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 2:
            run(3)
            # as if the last batch had failed after its tail and before its own commit
            (tmp_path / "state" / "commits" / "2").unlink()
            (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
    run(6)
    assert len(sinks.file_names(spark, f"{tmp_path}/state/tails")) == 2
    want = feature_table(state_for(Catalog(found, 10**9, "sec"), SPECS, chunked=False), SPECS)
    names = sorted(want.columns)
    streamed = sorted(str([r[c] for c in names]) for part in got.values() for r in part)
    assert streamed == sorted(str([r[c] for c in names]) for r in want.collect()) and len(streamed) > 300


def test_a_tail_holds_the_longest_window_and_the_last_quote(spark):
    rows = [("quotes", t, t) for t in range(0, 100, 7)] + [("trades", t, t) for t in range(100)] + [("second_feed", t, t) for t in range(0, 90, 10)]
    df = spark.createDataFrame(rows, "kind string, timestamp long, seq long").withColumn("fresh", F.lit(True))
    specs = [Spec("a", "flow_imbalance", 5), Spec("b", "feed_strength", 3, "second_feed")]
    kept = {(r.kind, r.timestamp) for r in next_tail(df, specs, {"second_feed": 10}).collect()}
    assert kept == {("trades", t) for t in range(83, 100)} | {("quotes", t) for t in (77, 84, 91, 98)}
    assert next_tail(df.where("false"), specs, {}).count() == 0
