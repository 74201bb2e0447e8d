"""Results and metadata as files, in any store Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; ``single`` writes one file, for small results such as curves and summaries."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> DataFrame:
    """CSV with a header under a declared schema; missing required columns raise ValueError."""
    have = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    if missing := [c for c in (required or schema.names) if c not in have]:
        raise ValueError(f"missing columns: {missing}")
    kinds = {f.name: f.dataType for f in schema}
    df = spark.read.option("header", True).csv(path)
    return df.select(*(df[c].cast(kinds[c]).alias(c) for c in schema.names if c in have))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One metadata record, as JSON text."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder of any store, by name; nothing if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file of any store, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
