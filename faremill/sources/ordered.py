"""Totally ordered tables: numbered rows, and sorted file sets that appear at once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .tables import forbid, require

_ROW = (1 << 33) - 1  # the lower bits of a monotonically increasing id: the row within its partition


def numbered(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Adds each row's place, from 1, in a total order: ``order`` must end in a key that
    tells all rows apart, for equal rows are numbered as they come.

    Rows are dealt to ranges and sorted there, and that is written, because the bounds of
    the ranges come from a sample; a range's first place is the number of rows in the
    ranges before it.  Only the counts, a row a range, are summed in one task.
    """
    sorted_ = df.repartitionByRange(_ranges(df.sparkSession), *order).sortWithinPartitions(*order)
    dealt = scratch.written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select("_range", before.alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(_ROW) + 1).drop("_range", "_at", "_start")


def _ranges(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def publish(df: DataFrame, path: str, columns, order: list[Column], forbidden=(), name: str = "ordinal") -> str:
    """The declared columns, numbered in order, as a new version of the table at ``path``;
    its id.  Files are sorted and do not overlap.  A version is named in the table's log
    once its files are there, by a single small file that Spark's committer renames into
    place, so a reader sees the version before or this one, never a part of it."""
    spark = df.sparkSession
    rows = numbered(forbid(require(df, columns), forbidden), order, name).select(name, *columns)
    version = uuid.uuid4().hex
    at = f"{path.rstrip('/')}/versions/{version}"
    rows.repartitionByRange(_ranges(spark), name).sortWithinPartitions(name).write.parquet(at)
    log = f"{path.rstrip('/')}/log"
    last = _log(spark, log).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    count = spark.read.schema(rows.schema).parquet(at).count()
    spark.range(1).select((F.lit(last) + 1).cast("long").alias("number"), F.lit(version).alias("version"), F.lit(count).cast("long").alias("rows")).coalesce(1).write.mode("append").parquet(log)
    return version


def _log(spark: SparkSession, log: str) -> DataFrame:
    schema = "number long, version string, rows long"
    try:
        return spark.read.schema(schema).parquet(log)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table whose rows are all there."""
    last = _log(spark, f"{path.rstrip('/')}/log").orderBy(F.desc("number")).first()
    if last is None:
        raise ValueError(f"{path}: nothing is published")
    df = spark.read.parquet(f"{path.rstrip('/')}/versions/{last.version}")
    if df.count() != last.rows:
        raise ValueError(f"{path}: version {last.version} has lost rows")
    return df
