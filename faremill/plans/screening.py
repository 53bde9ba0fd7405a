"""Queries over normalisation and anomaly rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, consolidation, normalization
from .indexing import cells
from .roles import QUOTES, STAGES, quotes, registry

QUERIES, ORACLES, query = registry()


def _untidy(spark, sf_dir):
    """Quotes with the spelling faults that normalisation repairs."""
    q = quotes(spark, sf_dir)
    n = F.col("observation_id").cast("long")
    return q.withColumns(
        {
            "fare_class": F.when(n % 7 == 0, F.concat(F.lit("  "), F.upper("fare_class"))).when(n % 7 == 1, F.lit("Mystery")).otherwise(F.col("fare_class")),
            "origin": F.when(n % 5 == 0, F.lower("origin")).otherwise(F.col("origin")),
            "source": F.when(n % 13 == 0, F.lower("source")).otherwise(F.col("source")),
            "total_fare": F.when(n % 17 == 0, F.lit("n/a")).otherwise(F.col("total_fare").cast("string")),
        }
    )


@query(
    f"""WITH {STAGES}, u AS (SELECT *, event_id AS n FROM quotes),
l AS (
  SELECT 'fare_class' AS field, 'WHITESPACE_NORMALIZED' AS action FROM u WHERE n % 7 = 0
  UNION ALL SELECT 'fare_class', 'CASE_NORMALIZED' FROM u WHERE n % 7 = 0
  UNION ALL SELECT 'fare_class', 'UNKNOWN_VALUE' FROM u WHERE n % 7 = 1
  UNION ALL SELECT 'source', 'CASE_NORMALIZED' FROM u WHERE n % 13 = 0
  UNION ALL SELECT 'origin', 'CANONICALIZED' FROM u WHERE n % 5 = 0
  UNION ALL SELECT 'fees', 'MISSING_VALUE' FROM u WHERE n % 11 = 0
  UNION ALL SELECT 'total_fare', 'MISSING_VALUE' FROM u WHERE n % 37 = 0 AND n % 17 <> 0
  UNION ALL SELECT 'total_fare', 'UNPARSABLE_VALUE' FROM u WHERE n % 17 = 0
) SELECT field, action, count(*) AS n FROM l GROUP BY ALL"""
)
def normalize_report(spark, sf_dir):
    rows = normalization.normalized(_untidy(spark, sf_dir))
    return normalization.report(rows, "OBSERVATION", "observation_id").groupBy("field", "action").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {STAGES} SELECT CASE WHEN sold THEN 'SOLD_OUT' WHEN event_id % 17 = 0 THEN 'MISSING_PRICE' ELSE 'PRICED' END AS price_state,
  CASE WHEN sold OR event_id % 17 = 0 OR event_id % 11 = 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS fare_decomposition_state, count(*) AS n FROM quotes GROUP BY ALL"""
)
def price_state(spark, sf_dir):
    rows = normalization.normalized(_untidy(spark, sf_dir))
    return rows.groupBy("price_state", "fare_decomposition_state").agg(F.count(F.lit(1)).alias("n"))


POINTS = (
    STAGES
    + """, pts AS (
  SELECT *, row_number() OVER s - 1 AS prior, lag(cents, 1) OVER s AS l1, lag(cents, 2) OVER s AS l2, lag(cents, 3) OVER s AS l3
  FROM cell WHERE alignment = 'ANCHORED' AND cents IS NOT NULL WINDOW s AS (PARTITION BY origin, destination, fare_class ORDER BY round_key, cell_id)
), moves AS (
  SELECT *, sources >= 2 AND priced_flights >= 2 AS coherent, abs(cents / nullif(l1, 0) - 1) AS step, abs(cents / nullif(l3, 0) - 1) AS drift,
    sign(cents - l1) <> 0 AND sign(cents - l1) = sign(l1 - l2) AND sign(l1 - l2) = sign(l2 - l3) AS same FROM pts
)"""
)


def _renamed(df):
    """Carriers and flight numbers of mixed spelling."""
    return df.withColumns({"carrier": F.when(F.col("carrier") == "C0", F.lit(" 6e")).otherwise(F.col("carrier")), "flight_number": F.lower("flight_number")})


_FLAGS = lambda *parts: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in parts) + "], lambda x: x IS NOT NULL), '|')"


@query(
    f"""WITH {STAGES} SELECT cell_id AS consolidation_cell_id, CASE WHEN observations % 3 = 0 THEN 'Mystery' ELSE fare_class END AS fare_class_canonical, observations % 3 <> 0 AS fare_class_is_known,
  CASE WHEN observations % 3 <> 0 THEN list_position(['Economy Saver', 'Economy Standard', 'Economy Flexi'], fare_class) END AS fare_class_tier_rank, CASE WHEN cents IS NOT NULL THEN 'PRICED' ELSE 'NO_PRICE_CELL' END AS price_state,
  CAST(cents / 100 AS DOUBLE) AS consolidated_fare, round_key AS round_sort_key, CASE WHEN alignment = 'ANCHORED' THEN 'ANCHOR_TIMESTAMP' ELSE 'ROUND_ID' END AS round_sort_key_source,
  {_FLAGS(("MISSING_PRICE", "cents IS NULL"), ("UNKNOWN_FARE_CLASS", "observations % 3 = 0"))} AS normalization_flags FROM cell"""
)
def normalized_cells(spark, sf_dir):
    c = consolidation.cells(consolidation.members(quotes(spark, sf_dir)))
    n = F.col("observations")
    out = normalization.normalized_cells(c.withColumn("fare_class", F.when(n % 3 == 0, F.lit(" Mystery")).when(n % 2 == 0, F.upper("fare_class")).otherwise(F.col("fare_class"))))
    return out.select("consolidation_cell_id", "fare_class_canonical", "fare_class_is_known", "fare_class_tier_rank", "price_state", F.col("consolidated_fare_normalized").cast("double").alias("consolidated_fare"), "round_sort_key", "round_sort_key_source", "normalization_flags")


@query(
    f"""WITH {STAGES}, f AS (SELECT cell_id, flight, carrier, flight_number, any_value(round_key) AS round_key, count(cents) AS priced, count(*) FILTER (sold) AS sold FROM quotes GROUP BY ALL)
SELECT cell_id || '::FLT::' || flight || '|08:10' AS flight_cell_id, CASE WHEN carrier = 'C0' THEN '6E' ELSE carrier END AS carrier_canonical, carrier = 'C0' AS carrier_is_known, flight_number AS flight_number_canonical, '08:10' AS departure_time_canonical,
  CASE WHEN priced > 0 THEN 'PRICED' WHEN sold > 0 THEN 'SOLD_OUT' ELSE 'MISSING_PRICE' END AS price_state, round_key AS round_sort_key, {_FLAGS(("UNKNOWN_CARRIER", "carrier <> 'C0'"))} AS normalization_flags FROM f"""
)
def normalized_flight_cells(spark, sf_dir):
    f = consolidation.flight_cells(consolidation.members(quotes(spark, sf_dir)))
    return normalization.normalized_flight_cells(_renamed(f)).select("flight_cell_id", "carrier_canonical", "carrier_is_known", "flight_number_canonical", "departure_time_canonical", "price_state", "round_sort_key", "normalization_flags")


@query(
    f"""WITH {QUOTES}, m AS (SELECT *, event_id AS n, CASE WHEN event_id % 17 <> 0 THEN cents + CASE WHEN event_id % 19 = 0 THEN 500 ELSE 0 END END AS total FROM quotes),
d AS (SELECT *, total IS NOT NULL AND n % 11 <> 0 AS complete FROM m)
SELECT observation_id, CASE WHEN n % 13 = 0 THEN 'Somewhere' ELSE source END AS source_canonical, n % 13 <> 0 AS source_is_known, CASE WHEN carrier = 'C0' THEN '6E' ELSE carrier END AS carrier_canonical, strftime(cts, '%Y-%m-%dT%H:%M:%S') AS collection_timestamp_iso, round_key AS round_sort_key,
  CASE WHEN sold THEN 'SOLD_OUT' WHEN total IS NULL THEN 'MISSING_PRICE' ELSE 'PRICED' END AS price_state, complete AS fare_decomposition_complete, CASE WHEN complete THEN n % 19 <> 0 END AS fare_components_reconcile,
  {_FLAGS(("FARE_COMPONENTS_MISMATCH", "complete AND n % 19 = 0"), ("FARE_DECOMPOSITION_INCOMPLETE", "NOT complete"), ("MISSING_PRICE", "total IS NULL AND NOT sold"), ("UNKNOWN_CARRIER", "carrier <> 'C0'"), ("UNKNOWN_SOURCE", "n % 13 = 0"))} AS normalization_flags FROM d"""
)
def normalized_map(spark, sf_dir):
    q = quotes(spark, sf_dir)
    n = F.col("observation_id").cast("long")
    rows = _renamed(consolidation.members(q)).withColumns({"source": F.when(n % 13 == 0, F.lit("Somewhere")).otherwise(F.col("source")), "total_fare": F.when(n % 17 != 0, F.col("total_fare") + F.when(n % 19 == 0, 5).otherwise(0))})
    return normalization.normalized_map(rows, q).select("observation_id", "source_canonical", "source_is_known", "carrier_canonical", "collection_timestamp_iso", "round_sort_key", "price_state", "fare_decomposition_complete", "fare_components_reconcile", "normalization_flags")


def _rank(v):
    return f"CASE WHEN {v} > 0.3 THEN (CASE WHEN coherent THEN 'REVIEW' ELSE 'HIGH' END) ELSE (CASE WHEN coherent THEN 'INFO' ELSE 'REVIEW' END) END"


@query(
    f"""WITH {POINTS} SELECT cell_id AS entity_id, 'NOT_EVALUABLE' AS status, 'NONE' AS severity, NULL AS value FROM moves WHERE prior < 3 OR step IS NULL
UNION ALL SELECT cell_id, 'FLAGGED', {_rank('step')}, round(step, 6) FROM moves WHERE prior >= 3 AND step > 0.15"""
)
def series_lag_r05(spark, sf_dir):
    return anomaly.series_rules(cells(spark, sf_dir)).where("rule_id = 'R05'").select("entity_id", "status", "severity", "value")


@query(
    f"""WITH {POINTS} SELECT cell_id AS entity_id, 'NOT_EVALUABLE' AS status, 'NONE' AS severity, NULL AS value FROM moves WHERE prior < 4 OR l1 = 0 OR l2 = 0 OR l3 = 0
UNION ALL SELECT cell_id, 'FLAGGED', {_rank('drift')}, round(drift, 6) FROM moves WHERE prior >= 4 AND l1 <> 0 AND l2 <> 0 AND l3 <> 0 AND same AND drift > 0.15"""
)
def drift_r06(spark, sf_dir):
    return anomaly.series_rules(cells(spark, sf_dir)).where("rule_id = 'R06'").select("entity_id", "status", "severity", "value")


FLIGHTS = (
    STAGES
    + """, fl AS (
  SELECT q.cell_id, q.flight, q.cell_id || '::FLT::' || q.flight || '|08:10' AS fid, min(cents) AS lo, max(cents) AS hi, any_value(s1.n) AS n, any_value(s1.c) AS c FROM quotes q LEFT JOIN s1 ON q.cell_id = s1.cell_id AND q.flight = s1.flight GROUP BY q.cell_id, q.flight
), fm AS (
  SELECT cell_id, flight, median(c) AS med FROM s0 GROUP BY ALL
), dev AS (
  SELECT s0.cell_id, s0.flight, max(abs(c - med) / nullif(med, 0)) AS worst FROM s0 JOIN fm ON s0.cell_id = fm.cell_id AND s0.flight = fm.flight GROUP BY ALL
), fx AS (
  SELECT fl.*, worst, sources >= 2 AND priced_flights >= 2 AS coherent, coalesce(n, 0) AS k FROM fl JOIN cell ON cell.cell_id = fl.cell_id LEFT JOIN dev ON dev.cell_id = fl.cell_id AND dev.flight = fl.flight
)"""
)


@query(
    f"""WITH {FLIGHTS} SELECT fid AS entity_id, 'NOT_EVALUABLE' AS status, 'NONE' AS severity, CASE WHEN k = 1 THEN 'SINGLE_SOURCE_CELL' ELSE 'NO_PRICE_TO_EVALUATE' END AS reason, NULL AS value FROM fx WHERE k < 2 OR lo <= 0
UNION ALL SELECT fid, 'FLAGGED', CASE WHEN coherent THEN 'INFO' ELSE 'REVIEW' END, NULL, round((hi - lo) / lo, 6) FROM fx WHERE k >= 2 AND lo > 0 AND (hi - lo) / nullif(lo, 0) > 0.15"""
)
def dispersion_r07(spark, sf_dir):
    f = consolidation.flight_cells(consolidation.members(quotes(spark, sf_dir)))
    return anomaly.flight_rules(f, cells(spark, sf_dir)).where("rule_id = 'R07'").select("entity_id", "status", "severity", "reason", "value")


@query(
    f"""WITH {FLIGHTS} SELECT fid AS entity_id, 'NOT_EVALUABLE' AS status, 'NONE' AS severity, NULL AS value FROM fx WHERE k < 3 OR worst IS NULL
UNION ALL SELECT fid, 'FLAGGED', CASE WHEN coherent THEN 'INFO' ELSE 'REVIEW' END, round(worst, 6) FROM fx WHERE k >= 3 AND worst > 0.15"""
)
def source_dev_r08(spark, sf_dir):
    f = consolidation.flight_cells(consolidation.members(quotes(spark, sf_dir)))
    return anomaly.flight_rules(f, cells(spark, sf_dir)).where("rule_id = 'R08'").select("entity_id", "status", "severity", "value")


@query(
    f"""WITH {STAGES} SELECT 'R09' AS rule_id, cell_id AS entity_id, NULL AS reason FROM cell WHERE sources <= 1
UNION ALL SELECT 'R11', cell_id, 'NO_PRICE_CELL' FROM cell WHERE cents IS NULL UNION ALL SELECT 'R12', cell_id, 'UNALIGNED' FROM cell WHERE alignment <> 'ANCHORED'"""
)
def thin_r09(spark, sf_dir):
    return anomaly.cell_rules(cells(spark, sf_dir)).select("rule_id", "entity_id", "reason")


#: Series by the last digits of the fare, so that some are short at every size.
@query(f"""WITH {STAGES}, fine AS (SELECT 'SERIES::' || origin || '|' || destination || '|' || fare_class || ' ' || (coalesce(cents, 0) % 9973) || '|T45(40-50)|2024-03-01' AS entity_id, alignment = 'ANCHORED' AND cents IS NOT NULL AS there FROM cell)
SELECT entity_id, CAST(count(*) FILTER (there) AS DOUBLE) AS value FROM fine GROUP BY entity_id HAVING count(*) FILTER (there) <= 3""")
def history_r10(spark, sf_dir):
    c = cells(spark, sf_dir)
    fine = c.withColumn("fare_class", F.concat("fare_class", F.lit(" "), (F.coalesce("fare_cents", F.lit(0)) % 9973).cast("string")))
    return anomaly.history_rules(fine).select("entity_id", "value")


PEERS = (
    STAGES
    + """, pr AS (SELECT * FROM cell WHERE cents IS NOT NULL),
rm AS (SELECT origin, destination, fare_class, round_id, median(cents) AS med, count(*) AS n, quantile_cont(cents, 0.75) - quantile_cont(cents, 0.25) AS iqr FROM pr GROUP BY ALL),
pm AS (SELECT origin, destination, fare_class, median(cents) AS med, count(*) AS n, quantile_cont(cents, 0.75) - quantile_cont(cents, 0.25) AS iqr FROM pr GROUP BY ALL),
rd AS (SELECT pr.origin, pr.destination, pr.fare_class, pr.round_id, median(abs(cents - med)) AS mad FROM pr JOIN rm USING (origin, destination, fare_class, round_id) GROUP BY ALL),
pd AS (SELECT pr.origin, pr.destination, pr.fare_class, median(abs(cents - med)) AS mad FROM pr JOIN pm USING (origin, destination, fare_class) GROUP BY ALL),
z0 AS (
  SELECT cell_id, cents, sources >= 2 AND priced_flights >= 2 AS coherent, rm.n >= 5 AS own, CASE WHEN rm.n >= 5 THEN rm.n ELSE pm.n END AS n, CASE WHEN rm.n >= 5 THEN rm.med ELSE pm.med END AS med,
    CASE WHEN rm.n >= 5 THEN rd.mad ELSE pd.mad END AS mad, CASE WHEN rm.n >= 5 THEN rm.iqr ELSE pm.iqr END AS iqr
  FROM pr JOIN rm USING (origin, destination, fare_class, round_id) JOIN pm USING (origin, destination, fare_class) JOIN rd USING (origin, destination, fare_class, round_id) JOIN pd USING (origin, destination, fare_class)
), z AS (
  SELECT *, CASE WHEN n < 3 THEN NULL WHEN mad > 0 THEN 0.6745 * (cents - med) / mad WHEN iqr > 0 THEN (cents - med) / (iqr / 1.349) END AS z FROM z0
)"""
)


@query(
    f"""WITH {PEERS} SELECT cell_id AS entity_id, 'NOT_EVALUABLE' AS status, 'NONE' AS severity, NULL AS value FROM z WHERE z IS NULL
UNION ALL SELECT cell_id, 'NOT_EVALUABLE', 'NONE', NULL FROM cell WHERE cents IS NULL
UNION ALL SELECT cell_id, 'FLAGGED', CASE WHEN own AND abs(z) > 7 THEN (CASE WHEN coherent THEN 'REVIEW' ELSE 'HIGH' END) ELSE (CASE WHEN coherent THEN 'INFO' ELSE 'REVIEW' END) END, round(z, 6) FROM z WHERE abs(z) > 3.5"""
)
def peer_mad_r13(spark, sf_dir):
    return anomaly.peer_rules(cells(spark, sf_dir)).select("entity_id", "status", "severity", "value")


@query(
    f"""WITH {POINTS}, r AS (
  SELECT cell_id, 'R05' AS rule, {_rank('step')} AS sev FROM moves WHERE prior >= 3 AND step > 0.15 UNION ALL SELECT cell_id, 'R06', {_rank('drift')} FROM moves WHERE prior >= 4 AND l1 <> 0 AND l2 <> 0 AND l3 <> 0 AND same AND drift > 0.15
  UNION ALL SELECT cell_id, 'R09', 'INFO' FROM cell WHERE sources <= 1 UNION ALL SELECT cell_id, 'R11', 'INFO' FROM cell WHERE cents IS NULL UNION ALL SELECT cell_id, 'R12', 'INFO' FROM cell WHERE alignment <> 'ANCHORED'
), g AS (
  SELECT cell_id, string_agg(rule, ';' ORDER BY rule) AS rules, max(CASE sev WHEN 'HIGH' THEN 3 WHEN 'REVIEW' THEN 2 ELSE 1 END) AS k FROM r GROUP BY cell_id
) SELECT cell.cell_id AS consolidation_cell_id, coalesce(rules, '') AS flagged_rules, ['NONE', 'INFO', 'REVIEW', 'HIGH'][coalesce(k, 0) + 1] AS severity FROM cell LEFT JOIN g ON g.cell_id = cell.cell_id"""
)
def severity_rollup(spark, sf_dir):
    c = cells(spark, sf_dir).drop("severity")
    rows = anomaly.series_rules(c).unionByName(anomaly.cell_rules(c))
    return anomaly.annotated_cells(c, rows).select("consolidation_cell_id", F.coalesce("flagged_rules", F.lit("")).alias("flagged_rules"), "severity")


@query(
    f"""WITH {STAGES} SELECT observation_id AS entity_id, rule AS rule_id, 'NOT_EVALUABLE' AS status FROM quotes, (VALUES ('R01'), ('R02')) v(rule) WHERE sold UNION ALL SELECT observation_id, 'R03', 'NOT_EVALUABLE' FROM quotes WHERE sold OR event_id % 11 = 0
UNION ALL SELECT observation_id, 'R01', 'FLAGGED' FROM quotes WHERE cents <= 0"""
)
def observation_r01_r03(spark, sf_dir):
    return anomaly.observation_rules(quotes(spark, sf_dir)).select("entity_id", "rule_id", "status")


@query(
    f"""WITH {STAGES} SELECT source, count(*) AS observations, count(cents) AS priced_observations, count(*) FILTER (sold) AS sold_out_observations, count(DISTINCT q.cell_id) AS cells,
  round(median(abs(cents - s1.c) / nullif(s1.c, 0)) FILTER (cents IS NOT NULL), 6) AS median_deviation, round(max(abs(cents - s1.c) / nullif(s1.c, 0)) FILTER (cents IS NOT NULL), 6) AS max_deviation
FROM quotes q LEFT JOIN s1 ON q.cell_id = s1.cell_id AND q.flight = s1.flight GROUP BY source"""
)
def source_reliability(spark, sf_dir):
    m = consolidation.members(quotes(spark, sf_dir))
    return anomaly.source_reliability(m, consolidation.flight_cells(m)).drop("missing_price_observations")


@query(
    f"""WITH {POINTS} SELECT origin, destination, fare_class, count(*) AS points, min(round_key) AS first_round, max(round_key) AS last_round, min(cents) AS min_cents, max(cents) AS max_cents, median(cents) AS median_cents, round(max(step), 6) AS max_abs_change FROM moves GROUP BY ALL"""
)
def series_diagnostics(spark, sf_dir):
    return anomaly.series_diagnostics(cells(spark, sf_dir)).drop("advance_purchase_window", "travel_date")
