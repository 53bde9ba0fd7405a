"""Lookups in several sources, in order of preference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .routes import small


def preferred(key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """(key, value) tables by name, the preferred one first -> one row a key: value,
    lookup_source, and values, the number of different ones that the source has.

    A null value counts as none, so the next source answers.  Of several values in one
    source the least is taken, and their number tells.
    """
    each = [df.select(F.col(key).alias("key"), F.col("value"), F.struct(F.lit(place).alias("place"), F.lit(name).alias("name")).alias("source")) for place, (name, df) in enumerate(sources.items())]
    rows = reduce(DataFrame.unionByName, each).where("key is not null and value is not null")
    by_source = rows.groupBy("key", "source").agg(F.min("value").alias("value"), F.count_distinct("value").alias("values"))
    best = by_source.groupBy("key").agg(F.min_by(F.struct("value", "source", "values"), "source").alias("b"))
    return best.select(F.col("key").alias(key), "b.value", F.col("b.source.name").alias("lookup_source"), "b.values")


def looked_up(rows: DataFrame, key: str, sources: dict[str, DataFrame], name: str) -> DataFrame:
    """Adds ``name``, lookup_source and mapping_status to rows: MAPPED, or FLAG_FOR_REVIEW
    where no source has the key or the one that answers has several values; such a value
    is not used.  All sources meet the rows in one join; the table of answers is broadcast
    once it is known to be small."""
    found = small(preferred(key, sources).withColumnRenamed("value", "_value"))
    out = rows.join(found, key, "left")
    sure = F.coalesce(F.col("values") == 1, F.lit(False))
    status = F.when(sure, "MAPPED").otherwise("FLAG_FOR_REVIEW")
    reason = F.when(sure, F.lit(None)).when(F.col("values") > 1, "SEVERAL_VALUES").otherwise("NO_SOURCE")
    return out.withColumns({name: F.when(sure, F.col("_value")), "mapping_status": status, "review_reason": reason}).drop("_value", "values")
