"""Preparation of a published city-pair table: header rows, cells that ran over into
the next column, city names, passenger counts, and a profile of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: A name's end found in the next cell is at most this long.
MOST_SPILLED = 6


def is_header(first: Column, patterns: tuple[str, ...]) -> Column:
    """Blank, or holding one of the header's texts."""
    text = F.trim(F.coalesce(first, F.lit("")))
    hit = text == ""
    for p in patterns:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def city(c: Column) -> Column:
    return F.upper(S.clean(F.coalesce(c, F.lit(""))))


def passengers(c: Column) -> Column:
    """struct(value, flag): a count, thousands separated or not; a dash is no service."""
    text = F.trim(c)
    value = F.regexp_replace(text, ",", "").try_cast("long")
    flag = F.when(F.coalesce(text, F.lit("")) == "", "MISSING_EMPTY").when(text == "-", "DGCA_DASH").when(value.isNull(), F.concat(F.lit("UNPARSEABLE:'"), text, F.lit("'"))).otherwise("")
    return F.struct(value.alias("value"), flag.alias("flag"))


def repaired(rows: DataFrame, left: str, right: str, known: tuple[str, ...], kind: str) -> DataFrame:
    """A known long name in ``left`` whose end spilled into ``right`` is made whole; the
    kind of repair goes to repair_type, where there was none before."""
    a, b = F.trim(F.col(left)), F.trim(F.col(right))
    before = F.col("repair_type") if "repair_type" in rows.columns else F.lit("")
    name, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for full in reversed(known):
        size = F.length(a)
        spilled = F.upper(F.lit(full)).startswith(F.upper(a)) & (F.lit(len(full)) - size).between(1, MOST_SPILLED)
        hit = spilled & F.upper(b).startswith(F.substring(F.lit(full.upper()), size + 1, F.lit(len(full)))) & (before == "")
        name = F.when(hit, F.lit(full)).otherwise(name)
        rest = F.when(hit, F.trim(F.substring(b, F.lit(len(full)) - size + 1, F.length(b)))).otherwise(rest)
    out = rows.withColumns({"_name": name, "_rest": rest})
    done = F.col("_name").isNotNull()
    return out.withColumns({left: F.coalesce("_name", left), right: F.when(done, F.col("_rest")).otherwise(F.col(right)), "repair_type": F.when(done, kind).otherwise(before)}).drop("_name", "_rest")


def prepared(raw: DataFrame, headers: tuple[str, ...], known: tuple[str, ...]) -> DataFrame:
    """(first, city_1, city_2, to_2, to_1), all text -> cleaned cities, counts with flags,
    both totals, and whether a row needs a look."""
    rows = repaired(raw.where(~is_header(F.col("first"), headers)), "city_2", "to_2", known, "CITY2_PAX_BOUNDARY_BLEED")
    rows = repaired(rows, "city_1", "city_2", known, "CITY1_CITY2_BOUNDARY_BLEED")
    out = rows.withColumns({"city_1": city(F.col("city_1")), "city_2": city(F.col("city_2")), "_a": passengers(F.col("to_2")), "_b": passengers(F.col("to_1"))})
    a, b = F.col("_a.value"), F.col("_b.value")
    out = out.withColumns({"passengers_out": a, "passengers_back": b, "flag_out": F.col("_a.flag"), "flag_back": F.col("_b.flag"), "total": F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))})
    return out.withColumn("needs_review", (F.col("flag_out") != "") | (F.col("flag_back") != "") | (F.col("city_1") == F.col("city_2"))).drop("_a", "_b", "to_2", "to_1")


def profile(rows: DataFrame) -> DataFrame:
    """Counts of rows, pairs, repeats and gaps, and the extremes, in one row."""
    pair = F.struct("city_1", "city_2")
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~F.col("needs_review")).alias("valid_rows"),
        F.count_if("needs_review").alias("invalid_rows"),
        F.count_distinct(pair).alias("unique_pairs"),
        (F.count(F.lit(1)) - F.count_distinct(pair)).alias("duplicate_pairs"),
        F.count_if(F.col("city_1") == F.col("city_2")).alias("self_pairs"),
        F.count_if(F.col("passengers_out").isNull()).alias("missing_out"),
        F.count_if(F.col("passengers_back").isNull()).alias("missing_back"),
        F.min("passengers_out").alias("least"),
        F.max("passengers_out").alias("most"),
        F.sum("total").alias("total"),
    )
