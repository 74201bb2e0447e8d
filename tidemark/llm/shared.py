"""What the operators share: reading tables, and results cut from their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources.scratch import shared_folder, written

__all__ = ["map_texts", "shared_folder", "table", "written"]

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir``, which may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_texts(rows: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` for long texts: the session's batches get at most 1,000 rows from then on, unless it sets a number of its own.

    Spark's default of 10,000 rows would hold tens of megabytes of text several times in each worker and executor.
    """
    conf = rows.sparkSession.conf
    if conf.get(ROWS, "-7") == "-7":  # not set, whatever the default
        conf.set(ROWS, "1000")
    return rows.mapInArrow(run, schema)
