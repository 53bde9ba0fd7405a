"""A folder for intermediate tables that driver and executors both reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``; a local folder serves only where that is unset and
    Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        named = "file://" + os.path.join(tempfile.gettempdir(), "faremill-core")
    if not named:
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
    return named.rstrip("/")


def folder(spark: SparkSession, tag: str) -> str:
    return f"{root(spark)}/faremill-core/{tag}-{uuid.uuid4().hex}"


def dropped_at_exit(spark: SparkSession, path: str) -> None:
    """A folder that is there goes when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table of its own: its lineage is cut, and what was random is fixed."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    dropped_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
