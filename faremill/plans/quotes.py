"""Queries over single observations and consolidated cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import consolidation, dedup, validation
from .roles import QUOTES, RAW, STAGES, kept, quotes, raw_observations, registry

QUERIES, ORACLES, query = registry()


@query(f"WITH {RAW} SELECT code, count(*) AS n FROM (SELECT unnest(errors) AS code FROM verdicts) GROUP BY code")
def validate_codes(spark, sf_dir):
    return validation.code_counts(validation.validate(raw_observations(spark, sf_dir)))


@query(f"WITH {RAW} SELECT validation_status, count(*) AS n FROM verdicts GROUP BY ALL")
def validate_status_counts(spark, sf_dir):
    return validation.status_counts(validation.validate(raw_observations(spark, sf_dir)))


@query(f"WITH {RAW} SELECT observation_id, price, validation_status, array_to_string(errors, ';') AS errors FROM verdicts")
def validate_rows(spark, sf_dir):
    v = validation.validate(raw_observations(spark, sf_dir))
    price = F.regexp_replace("base_fare", "-", "").cast("decimal(18,2)")
    return v.select("observation_id", S.cents(price).alias("price"), "validation_status", F.array_join("validation_errors", ";").alias("errors"))


@query(f"WITH {RAW} SELECT CASE WHEN timed THEN band END AS band, count(*) AS n FROM flat GROUP BY ALL")
def window_bands(spark, sf_dir):
    raw = raw_observations(spark, sf_dir)
    gap = F.datediff(S.date(F.col("travel_date")), S.timestamp(F.col("collection_timestamp")).cast("date"))
    return raw.groupBy(S.expected_window(gap).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {QUOTES} SELECT observation_id, round_id AS collection_round_id, alignment AS round_alignment, anchor AS round_anchor_timestamp, round_key AS round_sort_key FROM quotes")
def round_assignment(spark, sf_dir):
    m = consolidation.members(quotes(spark, sf_dir))
    return m.select("observation_id", "collection_round_id", "round_alignment", "round_anchor_timestamp", S.round_sort_key(F.col("round_anchor_timestamp"), F.col("collection_round_id")).alias("round_sort_key"))


def _banded(spark, sf_dir, events=None):
    """Quotes whose fare is a band of 20.00, so that captures repeat."""
    q = quotes(spark, sf_dir, events)
    return q.withColumn("total_fare", (F.floor(F.col("total_fare") / 20) * 20).cast("decimal(18,2)")).where("total_fare is not null or availability_status = 'Sold Out'")


def _deduplicated(spark, sf_dir):
    return kept(spark, sf_dir, "deduplicated", lambda: dedup.deduplicate(_banded(spark, sf_dir)), persist=False)


_SWEEP = (
    "WITH RECURSIVE "
    + QUOTES
    + """, b AS (
  SELECT observation_id, cts, concat_ws('|', origin, destination, carrier, flight_number, fare_class, source, CASE WHEN sold THEN 'S' ELSE CAST(cents // 2000 AS VARCHAR) END) AS bucket, sold FROM quotes
), anchors AS (
  SELECT bucket, min(cts) AS a FROM b GROUP BY bucket
  UNION ALL
  SELECT n.bucket, n.a FROM (SELECT b.bucket, min(b.cts) AS a FROM anchors JOIN b ON b.bucket = anchors.bucket AND b.cts > anchors.a + INTERVAL 15 MINUTE GROUP BY b.bucket) n
), placed AS (
  SELECT b.*, (SELECT max(a) FROM anchors WHERE anchors.bucket = b.bucket AND a <= b.cts) AS a FROM b
), swept AS (
  SELECT *, first_value(observation_id) OVER (PARTITION BY bucket, a ORDER BY cts, observation_id) AS canonical, count(*) OVER (PARTITION BY bucket, a) AS size FROM placed
)"""
)


@query(
    _SWEEP
    + """ SELECT observation_id, CASE WHEN size > 1 THEN 'DUPGRP-' || canonical ELSE 'SINGLETON::' || observation_id END AS duplicate_group_id,
  CASE WHEN size = 1 THEN 'RETAINED_UNIQUE' WHEN canonical = observation_id THEN 'RETAINED_CANONICAL_OF_DUPLICATE_GROUP' WHEN sold THEN 'SOLD_OUT_TECHNICAL_DUPLICATE' ELSE 'TECHNICAL_DUPLICATE' END AS duplicate_reason,
  size = 1 OR canonical = observation_id AS retained FROM swept"""
)
def dedup_sweep(spark, sf_dir):
    return _deduplicated(spark, sf_dir).select("observation_id", "duplicate_group_id", "duplicate_reason", "retained")


@query(
    _SWEEP
    + """ SELECT 'DUPGRP-' || canonical AS duplicate_group_id, canonical AS canonical_id, count(*) AS group_size, string_agg(observation_id, ';' ORDER BY observation_id) AS member_ids,
  CAST(date_diff('minute', min(cts), max(cts)) AS BIGINT) AS max_delta_minutes FROM swept WHERE size > 1 GROUP BY canonical"""
)
def dedup_report(spark, sf_dir):
    return dedup.duplicate_report(_deduplicated(spark, sf_dir)).drop("capture_signature_agreement")


@query(f"WITH {STAGES} SELECT cell_id || '::FLT::' || flight || '|08:10' AS flight_cell_id, c AS flight_cents, n AS priced_sources, spread AS source_spread_cents FROM s1")
def flight_median(spark, sf_dir):
    f = consolidation.flight_cells(consolidation.members(quotes(spark, sf_dir)))
    return f.where("flight_cents is not null").select("flight_cell_id", "flight_cents", "priced_sources", "source_spread_cents")


@query(
    f"""WITH {STAGES} SELECT cell_id AS consolidation_cell_id, cents AS fare_cents, observations, priced AS priced_observations, sold_out AS sold_out_observations, flights, priced_flights, sources AS participating_sources,
  CASE WHEN cents IS NOT NULL THEN 'CONSOLIDATED' ELSE 'NO_PRICE_ALL_SOLD_OUT' END AS consolidation_status, min_cents, max_cents FROM cell"""
)
def cell_median(spark, sf_dir):
    c = consolidation.cells(consolidation.members(quotes(spark, sf_dir)))
    return c.select("consolidation_cell_id", "fare_cents", "observations", "priced_observations", "sold_out_observations", "flights", F.nullif("priced_flights", F.lit(0)).alias("priced_flights"), "participating_sources", "consolidation_status", "min_cents", "max_cents")


@query(
    f"WITH {STAGES}, p AS (SELECT cell_id, source, CAST(floor(median(cents) + 0.5) AS BIGINT) AS c FROM quotes WHERE cents IS NOT NULL GROUP BY ALL) SELECT cell_id AS consolidation_cell_id, CAST(floor(median(c) + 0.5) AS BIGINT) AS source_first_cents FROM p GROUP BY ALL"
)
def alt_source_first(spark, sf_dir):
    return consolidation.source_first(consolidation.members(quotes(spark, sf_dir)))


@query(f"WITH {STAGES} SELECT cell_id AS consolidation_cell_id, max_spread AS max_flight_source_spread_cents, median_spread AS median_flight_source_spread_cents, cross_spread AS cross_flight_spread_cents FROM cell")
def dispersion(spark, sf_dir):
    return consolidation.cells(consolidation.members(quotes(spark, sf_dir))).select("consolidation_cell_id", "max_flight_source_spread_cents", "median_flight_source_spread_cents", "cross_flight_spread_cents")


@query(
    f"""WITH {STAGES} SELECT CASE sources WHEN 0 THEN 'NO_SOURCE' WHEN 1 THEN 'SINGLE_SOURCE' WHEN 4 THEN 'FULL' ELSE 'PARTIAL' END AS source_coverage, count(*) AS n_cells,
  CAST(sum(4 - sources) AS BIGINT) AS n_missing_sources FROM cell GROUP BY ALL"""
)
def source_coverage(spark, sf_dir):
    c = consolidation.cells(consolidation.members(quotes(spark, sf_dir)))
    return c.groupBy("source_coverage").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.size("missing_sources")).alias("n_missing_sources"))


@query(
    f"WITH {STAGES} SELECT q.observation_id, CASE WHEN sold THEN 'EXCLUDED_SOLD_OUT' ELSE 'PARTICIPATED' END AS participation_status, s1.c AS flight_cents, s2.c AS cell_cents FROM quotes q LEFT JOIN s1 ON q.cell_id = s1.cell_id AND q.flight = s1.flight LEFT JOIN s2 ON q.cell_id = s2.cell_id"
)
def observation_map(spark, sf_dir):
    return consolidation.observation_map(consolidation.members(quotes(spark, sf_dir))).select("observation_id", "participation_status", "flight_cents", "cell_cents")
