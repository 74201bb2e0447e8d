"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode, where all tasks share the driver's disk.

    A cluster that names none raises ValueError, since its executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if folder is None:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, spark: SparkSession, by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and no executor's loss brings it back. ``by`` names a column to partition it by."""
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*(f"`{c}`" for c in df.columns)) if by else out


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written so far; results that were not collected or saved are lost with them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
