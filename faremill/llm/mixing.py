"""Mixing sources to target weights, on DataFrame functions alone.

Documents get a hash-random order within their source.  The order is cut into
buckets by the key's leading digits; bucket sums give each bucket its offset, and a
window within a bucket the rest of the prefix sum, so that a source with a third of
all rows is summed by many tasks.  Rows alike in source, doc_id and size are one row
of that window, so null or repeated ids add at most a row a size.  A document's share of the cut follows from the
words before it: whole epochs first, then the last, partial one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Digits of the key that name a bucket: 65,536 buckets a source.
BUCKET_DIGITS = 4
#: Digits that name a run of buckets: 256 runs of 256 buckets a source.
HIGH_DIGITS = 2
MOST_EPOCHS = 3
WEIGHTS = (1, 2, 3)
_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources by code point, null last, weigh 1, 2, 3, repeating.  A target stops at
    three times its source's size and the excess is reshared by weight: with the
    sources sorted by cap over weight, the stopped ones are a prefix, and the level
    of the others follows from the sums before them.  One row a source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (turn % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", MOST_EPOCHS * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("total", F.sum("source_size").over(everything))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(_FIRST, -1)), F.lit(0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, _LAST)))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # The first row that its level does not fill sets the level for itself and all after it.
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size,
    target, taken.

    Null text has size 0.  A null source is a source of its own, a null doc_id is
    ordered after the others; rows alike in doc_id and size are interchangeable and
    are taken one after another.  taken is exact: the taken words of a source sum to
    its target, rounded down.  Other columns are not read.  An empty table gives an
    empty result.
    """
    narrow = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("g")).alias("key"))
    narrow = common.materialize(narrow, "sizes").withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    by_bucket = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    # Prefix sums of the buckets in two steps, so that no window holds all of a source's.
    by_bucket = by_bucket.withColumn("high", F.substring("bucket", 1, HIGH_DIGITS))
    ahead = lambda size, order, *keys: F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(_FIRST, -1)), F.lit(0))
    by_high = by_bucket.groupBy("source", "high").agg(F.sum("bucket_size").alias("high_size")).select(F.col("source").alias("hs"), F.col("high").alias("hh"), ahead("high_size", "high", "source").alias("high_offset"))
    offsets = by_bucket.withColumn("low_offset", ahead("bucket_size", "bucket", "source", "high"))
    offsets = offsets.join(by_high, F.col("source").eqNullSafe(F.col("hs")) & (F.col("high") == F.col("hh"))).withColumn("offset", F.col("high_offset") + F.col("low_offset"))
    offsets = offsets.join(by_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "bucket", "offset", "source_size", "target")
    named = offsets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(_FIRST, -1)
    alike = narrow.groupBy("source", "bucket", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("times"))
    rows = alike.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("times")).over(within), F.lit(0)))
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rows = common.repeated(rows, "times", "nth").withColumn("inside", F.col("before") + (F.col("nth") - 1) * F.col("size"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("offset") - F.col("inside")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.documents(spark, sf_dir)).drop("source")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), l AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap)) AS target FROM l
), r AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) AS BIGINT) AS taken
FROM r
"""
