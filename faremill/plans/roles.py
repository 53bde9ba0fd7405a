"""The driver's tables in the roles of the domain, in Spark and in SQL.

events: a captured quote an event.  lineitem with orders, customer and supplier: raw,
all-text observations with every kind of flaw.  orders by month: the reference series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days that bring the order dates after the year 2000.
SHIFT = 5000
CLASSES = ("Economy Saver", "Economy Standard", "Economy Flexi")


def registry():
    """Queries and oracles of a module, and the decorator that fills them."""
    found, oracles = {}, {}

    def query(sql: str | None):
        def add(f):
            found[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return found, oracles, query


_KEPT: dict[str, tuple] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make, persist: bool = True) -> DataFrame:
    """A table that several queries of a folder read: made once, and persisted.  The one
    of another folder is let go, so a session never holds two of a name."""
    at = (spark.sparkContext.applicationId, sf_dir)
    old, df = _KEPT.get(name, (None, None))
    if old != at:
        if df is not None and old[0] == at[0]:
            df.unpersist()
        df = make()
        _KEPT[name] = (at, df)
    return df.persist() if persist and not df.storageLevel.useMemory else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Validated, typed-as-text observations from events, a table or a stream of them."""
    e = table(spark, sf_dir, "events") if events is None else events
    hub, code = F.lit("ZZZ"), F.upper(F.substring("event_type", 1, 3))
    odd = F.col("user_id") % 2 == 1
    cents = F.round(F.col("value") * 100).cast("long")
    sold = F.col("event_id") % 37 == 0
    dec = lambda c: (c / 100).cast("decimal(18,2)")
    base, taxes = F.floor(cents * 80 / 100).cast("long"), F.floor(cents * 15 / 100).cast("long")
    return e.select(
        F.col("event_id").cast("string").alias("observation_id"),
        F.when(odd, hub).otherwise(code).alias("origin"),
        F.when(odd, code).otherwise(hub).alias("destination"),
        F.concat(F.lit("C"), (F.col("user_id") % 2).cast("string")).alias("carrier"),
        F.concat(F.lit("FL"), (F.col("user_id") % 2).cast("string")).alias("flight_number"),
        F.lit("2024-03-01").alias("travel_date"),
        F.lit("08:10").alias("departure_time"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("collection_timestamp"),
        F.lit("T45(40-50)").alias("advance_purchase_window"),
        F.element_at(F.array(*[F.lit(x) for x in CLASSES]), (F.col("user_id") % 3 + 1).cast("int")).alias("fare_class"),
        dec(base).alias("base_fare"),
        dec(taxes).alias("taxes"),
        F.when(F.col("event_id") % 11 != 0, dec(cents - base - taxes)).alias("fees"),
        F.when(~sold, dec(cents)).alias("total_fare"),
        F.element_at(F.array(F.lit("AirlineSite"), F.lit("Cleartrip"), F.lit("Goibibo"), F.lit("MMT")), (F.col("user_id") % 4 + 1).cast("int")).alias("source"),
        F.when(sold, "Sold Out").otherwise("Available").alias("availability_status"),
        F.lit(True).alias("is_valid"),
    )


#: The same, with the round, in SQL.
QUOTES = """
q0 AS (
  SELECT CAST(event_id AS VARCHAR) AS observation_id, event_id, user_id,
    CASE WHEN user_id % 2 = 1 THEN 'ZZZ' ELSE upper(substring(event_type, 1, 3)) END AS origin,
    CASE WHEN user_id % 2 = 1 THEN upper(substring(event_type, 1, 3)) ELSE 'ZZZ' END AS destination,
    'C' || (user_id % 2) AS carrier, 'FL' || (user_id % 2) AS flight_number,
    ['Economy Saver', 'Economy Standard', 'Economy Flexi'][user_id % 3 + 1] AS fare_class,
    ['AirlineSite', 'Cleartrip', 'Goibibo', 'MMT'][user_id % 4 + 1] AS source,
    date_trunc('minute', ts) AS cts, event_id % 37 = 0 AS sold,
    CAST(round(value * 100) AS BIGINT) AS all_cents,
    CASE WHEN event_id % 37 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS cents
  FROM events
), q1 AS (
  SELECT *, date_part('hour', cts) * 60 + date_part('minute', cts) AS m, strftime(cts, '%Y-%m-%d') AS day FROM q0
), q2 AS (
  SELECT *, CASE WHEN abs(m - 540) <= 30 THEN '09:00' WHEN abs(m - 870) <= 30 THEN '14:30' WHEN abs(m - 1215) <= 30 THEN '20:15' END AS anchor_time FROM q1
), quotes AS (
  SELECT *, CASE WHEN anchor_time IS NOT NULL THEN day || ' ' || anchor_time END AS anchor,
    CASE WHEN anchor_time IS NOT NULL THEN 'ROUND-' || day || ' ' || anchor_time ELSE 'ROUND-UNALIGNED::' || strftime(cts, '%Y-%m-%d %H:%M') END AS round_id,
    CASE WHEN anchor_time IS NOT NULL THEN 'ANCHORED' ELSE 'UNALIGNED' END AS alignment,
    CASE WHEN anchor_time IS NOT NULL THEN day || ' ' || anchor_time ELSE strftime(cts, '%Y-%m-%d %H:%M') END AS round_key,
    'CELL::' || origin || '|' || destination || '|2024-03-01|' || fare_class || '|T45(40-50)::'
      || CASE WHEN anchor_time IS NOT NULL THEN 'ROUND-' || day || ' ' || anchor_time ELSE 'ROUND-UNALIGNED::' || strftime(cts, '%Y-%m-%d %H:%M') END AS cell_id,
    carrier || '|' || flight_number AS flight
  FROM q2
)"""

#: Medians of the three stages in SQL; half a cent goes up.
STAGES = (
    QUOTES
    + """, s0 AS (
  SELECT cell_id, flight, source, CAST(floor(median(cents) + 0.5) AS BIGINT) AS c FROM quotes WHERE cents IS NOT NULL GROUP BY ALL
), s1 AS (
  SELECT cell_id, flight, CAST(floor(median(c) + 0.5) AS BIGINT) AS c, count(*) AS n, max(c) - min(c) AS spread FROM s0 GROUP BY ALL
), s2 AS (
  SELECT cell_id, CAST(floor(median(c) + 0.5) AS BIGINT) AS c, count(*) AS n, max(spread) AS max_spread,
    CAST(floor(median(spread) + 0.5) AS BIGINT) AS median_spread, max(c) - min(c) AS cross_spread FROM s1 GROUP BY ALL
), cell AS (
  SELECT q.cell_id, any_value(origin) AS origin, any_value(destination) AS destination, any_value(fare_class) AS fare_class,
    any_value(round_id) AS round_id, any_value(alignment) AS alignment, any_value(anchor) AS anchor, any_value(round_key) AS round_key,
    count(*) AS observations, count(cents) AS priced, count(*) FILTER (sold) AS sold_out, count(DISTINCT flight) AS flights,
    count(DISTINCT source) FILTER (cents IS NOT NULL) AS sources, min(cents) AS min_cents, max(cents) AS max_cents,
    any_value(s2.c) AS cents, any_value(s2.n) AS priced_flights, any_value(s2.max_spread) AS max_spread, any_value(s2.median_spread) AS median_spread, any_value(s2.cross_spread) AS cross_spread
  FROM quotes q LEFT JOIN s2 ON q.cell_id = s2.cell_id GROUP BY q.cell_id
)"""
)


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text observations from lineitem, its order, customer and supplier."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    code = lambda x: F.concat(F.lit("N"), F.lpad(x.cast("string"), 2, "0"))
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    taxes = F.round(F.col("l_extendedprice") * F.col("l_tax") * 100).cast("long")
    text = lambda x: (x / 100).cast("decimal(18,2)").cast("string")
    gap = F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("observation_id"),
        code(F.col("s_nationkey")).alias("origin"),
        code(F.col("c_nationkey")).alias("destination"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("carrier"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("flight_number"),
        F.date_format(F.date_add("l_shipdate", SHIFT), "yyyy-MM-dd").alias("travel_date"),
        F.when(F.col("l_linenumber") == 4, "8:10").when(F.col("l_linenumber") != 5, "08:10").alias("departure_time"),
        F.when(F.col("l_partkey") % 97 != 0, F.date_format(F.date_add("o_orderdate", SHIFT), "yyyy-MM-dd HH:mm")).alias("collection_timestamp"),
        F.when(F.col("l_linenumber") != 6, gap.cast("string")).otherwise("n/a").alias("advance_purchase_days"),
        F.lit("T45(40-50)").alias("advance_purchase_window"),
        F.col("l_returnflag").alias("fare_class"),
        F.when(F.col("l_partkey") % 89 == 0, F.concat(F.lit("-"), text(price))).otherwise(text(price)).alias("base_fare"),
        text(taxes).alias("taxes"),
        F.lit("0.00").alias("fees"),
        F.when(F.col("l_discount") == 0.1, "").when(F.col("l_discount") == 0.09, text(price - 100)).otherwise(text(price + taxes)).alias("total_fare"),
        F.when(F.col("l_suppkey") % 23 != 0, F.col("o_orderpriority")).alias("source"),
        F.when(F.col("o_orderstatus") == "P", "Sold Out").when(F.col("l_quantity") == 50, "Unknown").otherwise("Available").alias("availability_status"),
    )


RAW = """
raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS observation_id, s_nationkey, c_nationkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderstatus, l_discount,
    date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS gap,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) AS taxes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
), flat AS (
  SELECT *, l_partkey % 97 <> 0 AS timed, CASE WHEN l_partkey % 89 = 0 THEN -price ELSE price END AS base,
    CASE WHEN l_discount = 0.1 THEN NULL WHEN l_discount = 0.09 THEN price - 100 ELSE price + taxes END AS total,
    CASE WHEN o_orderstatus = 'P' THEN 'Sold Out' WHEN l_quantity = 50 THEN 'Unknown' ELSE 'Available' END AS status,
    CASE WHEN gap BETWEEN 0 AND 2 THEN 'T1(0-2)' WHEN gap BETWEEN 5 AND 9 THEN 'T7(5-9)' WHEN gap BETWEEN 12 AND 18 THEN 'T15(12-18)' WHEN gap BETWEEN 25 AND 35 THEN 'T30(25-35)' WHEN gap BETWEEN 40 AND 50 THEN 'T45(40-50)' ELSE 'OUT_OF_BAND' END AS band
  FROM raw
), codes AS (
  SELECT *, list_filter([
    CASE WHEN s_nationkey = c_nationkey THEN 'ORIGIN_EQUALS_DESTINATION' END,
    CASE WHEN NOT timed THEN 'MISSING_COLLECTION_TIMESTAMP' END,
    CASE WHEN l_linenumber = 4 THEN 'INVALID_DEPARTURE_TIME' END,
    CASE WHEN timed AND gap < 0 THEN 'TRAVEL_DATE_BEFORE_COLLECTION' END,
    CASE WHEN l_linenumber = 6 THEN 'NON_NUMERIC_ADVANCE_PURCHASE_DAYS' END,
    CASE WHEN timed AND gap >= 0 AND band <> 'T45(40-50)' THEN 'ADVANCE_PURCHASE_WINDOW_MISMATCH' END,
    CASE WHEN status = 'Unknown' THEN 'INVALID_AVAILABILITY_STATUS' END,
    CASE WHEN base < 0 THEN 'NEGATIVE_BASE_FARE' END,
    CASE WHEN total <= 0 THEN 'INVALID_TOTAL_FARE' END,
    CASE WHEN total IS NULL AND status = 'Available' THEN 'MISSING_TOTAL_FARE' END,
    CASE WHEN total / 100 < base / 100 + taxes / 100 - CAST(1 AS DOUBLE) THEN 'TOTAL_FARE_LESS_THAN_COMPONENTS' END,
    CASE WHEN l_suppkey % 23 = 0 THEN 'MISSING_SOURCE' END
  ], lambda x: x IS NOT NULL) AS errors FROM flat
), verdicts AS (
  SELECT *, CASE WHEN len(errors) > 0 THEN 'INVALID' WHEN status = 'Sold Out' THEN 'NON_PRICE_AVAILABILITY' WHEN l_linenumber = 5 THEN 'VALID_WITH_MISSING_OPTIONAL_FIELDS' ELSE 'VALID' END AS validation_status FROM codes
)"""
