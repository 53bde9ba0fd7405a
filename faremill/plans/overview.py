"""Queries over traffic preparation, disclosures, live quotes and severity overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import anomaly, backtest, dashboard, index, routes, traffic
from .indexing import ITEMS, ROUTED, cells, event_basket, grain_a, items, routed
from .reports import MONTHS, comparison
from .roles import registry, table
from .screening import POINTS, _rank

QUERIES, ORACLES, query = registry()

LONG_NAME = "Northern Harbour International Airport"


def _city_pairs(spark, sf_dir):
    """Customers in the role of printed city pairs, with the faults of such tables."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    fault, count = k % 10, F.format_number(k * 7, 0)
    return table(spark, sf_dir, "customer").select(
        F.when(fault == 3, "CITY PAIR").otherwise(k.cast("string")).alias("first"),
        F.when(fault == 2, "Northern Harbour International Air").otherwise(F.concat(F.lit("  town  "), n)).alias("city_1"),
        F.when(fault == 1, "NORTHERN HARBOUR INTERNATIONAL AIRP").when(fault == 2, F.concat(F.lit("PORT City "), n)).otherwise(F.concat(F.lit("City "), (k % 7).cast("string"))).alias("city_2"),
        F.when(fault == 1, F.concat(F.lit("ORT "), count)).when(fault == 4, "-").when(fault == 5, " ").when(fault == 6, "n/a").otherwise(count).alias("to_2"),
        k.cast("string").alias("to_1"),
    )


PAIRS = f"""pairs AS (
  SELECT c_custkey AS k, c_custkey % 10 AS fault, CASE WHEN c_custkey % 10 = 2 THEN upper('{LONG_NAME}') ELSE 'TOWN ' || c_nationkey END AS city_1,
    CASE WHEN c_custkey % 10 = 1 THEN upper('{LONG_NAME}') WHEN c_custkey % 10 = 2 THEN 'CITY ' || c_nationkey ELSE 'CITY ' || (c_custkey % 7) END AS city_2,
    CASE WHEN c_custkey % 10 NOT IN (4, 5, 6) THEN c_custkey * 7 END AS passengers_out, c_custkey AS passengers_back,
    CASE c_custkey % 10 WHEN 4 THEN 'DGCA_DASH' WHEN 5 THEN 'MISSING_EMPTY' WHEN 6 THEN 'UNPARSEABLE:' || chr(39) || 'n/a' || chr(39) ELSE '' END AS flag_out,
    CASE c_custkey % 10 WHEN 1 THEN 'CITY2_PAX_BOUNDARY_BLEED' WHEN 2 THEN 'CITY1_CITY2_BOUNDARY_BLEED' ELSE '' END AS repair_type
  FROM customer WHERE c_custkey % 10 <> 3
)"""


def _prepared(spark, sf_dir):
    return traffic.prepared(_city_pairs(spark, sf_dir), ("CITY PAIR", "S.No"), (LONG_NAME,))


@query(f"WITH {PAIRS} SELECT CAST(k AS VARCHAR) AS \"first\", city_1, city_2, CAST(passengers_out AS BIGINT) AS passengers_out, CAST(passengers_back AS BIGINT) AS passengers_back, flag_out, repair_type, CAST(coalesce(passengers_out, 0) + passengers_back AS BIGINT) AS total, flag_out <> '' AS needs_review FROM pairs")
def traffic_prepared(spark, sf_dir):
    return _prepared(spark, sf_dir).drop("flag_back")


@query(f"""WITH {PAIRS} SELECT count(*) AS total_rows, count(*) FILTER (flag_out = '') AS valid_rows, count(*) FILTER (flag_out <> '') AS invalid_rows, count(DISTINCT (city_1, city_2)) AS unique_pairs, count(*) - count(DISTINCT (city_1, city_2)) AS duplicate_pairs, 0 AS self_pairs,
  count(*) - count(passengers_out) AS missing_out, 0 AS missing_back, min(passengers_out) AS least, max(passengers_out) AS most, CAST(sum(coalesce(passengers_out, 0) + passengers_back) AS BIGINT) AS total FROM pairs""")
def traffic_profile(spark, sf_dir):
    return traffic.profile(_prepared(spark, sf_dir))


@query(f"""WITH {ITEMS}, b AS (SELECT count(*) AS n FROM basket) SELECT variant, seq AS link_sequence, routes AS basket_routes_represented, n AS basket_routes_total, round(weight, 6) AS basket_weight_represented, round(1 - weight, 6) AS basket_weight_missing, round(100 * weight, 4) AS basket_coverage_pct,
  CASE WHEN routes > 0 THEN 1.0 ELSE 0.0 END AS effective_weight_sum, routes > 0 AND routes < n AS renormalization_applied, CASE WHEN routes <= 0 THEN 'NO_BASKET_COVERAGE' WHEN routes = n THEN 'FULL_BASKET_COVERAGE' ELSE 'PARTIAL_COVERAGE_PROTOTYPE' END AS coverage_status FROM chain, b""")
def coverage_disclosure(spark, sf_dir):
    return index.coverage_disclosure(items(spark, sf_dir), event_basket(spark, sf_dir))


@query(f"""WITH {ITEMS} SELECT i.variant, r.seq AS link_sequence, count(*) FILTER (sev = 0) AS "none", count(*) FILTER (sev = 1) AS info, count(*) FILTER (sev = 2) AS review, count(*) FILTER (sev = 3) AS high,
  'HIGH=' || count(*) FILTER (sev = 3) || ';INFO=' || count(*) FILTER (sev = 1) || ';NONE=' || count(*) FILTER (sev = 0) || ';REVIEW=' || count(*) FILTER (sev = 2) AS packed
FROM items i JOIN rounds r ON i.round_id = r.round_id JOIN rel ON rel.variant = i.variant AND rel.seq = r.seq AND rel.item_id = i.item_id WHERE i.status = 'ELIGIBLE' AND rel.cur IS NOT NULL AND rel.prev IS NOT NULL GROUP BY i.variant, r.seq""")
def severity_counts(spark, sf_dir):
    return index.severity_counts(items(spark, sf_dir))


@query(f"WITH {ROUTED} SELECT consolidation_cell_id, route_id FROM (SELECT cell_id AS consolidation_cell_id, route_id FROM routed)")
def route_lineage(spark, sf_dir):
    r = routed(spark, sf_dir)
    return routes.lineage(r).join(r.select("consolidation_cell_id", "route_id"), "consolidation_cell_id").select("consolidation_cell_id", "route_id")


@query(f"WITH {ROUTED} SELECT DISTINCT 'origin' AS side, split_part(route_id, '-', 1) AS code FROM grain_a UNION SELECT DISTINCT 'destination', split_part(route_id, '-', 2) FROM grain_a UNION VALUES ('origin', 'QQQ'), ('destination', 'WWW')")
def filter_values(spark, sf_dir):
    return dashboard.filter_values(grain_a(spark, sf_dir))


FLAGS = f"""{POINTS}, r AS (
  SELECT cell_id, 'R05' AS rule, {_rank('step')} AS sev FROM moves WHERE prior >= 3 AND step > 0.15 UNION ALL SELECT cell_id, 'R06', {_rank('drift')} FROM moves WHERE prior >= 4 AND l1 <> 0 AND l2 <> 0 AND l3 <> 0 AND same AND drift > 0.15
  UNION ALL SELECT cell_id, 'R09', 'INFO' FROM cell WHERE sources <= 1 UNION ALL SELECT cell_id, 'R11', 'INFO' FROM cell WHERE cents IS NULL UNION ALL SELECT cell_id, 'R12', 'INFO' FROM cell WHERE alignment <> 'ANCHORED'
)"""


def _flags(c):
    return anomaly.series_rules(c).unionByName(anomaly.cell_rules(c)).where("status = 'FLAGGED'")


@query(f"WITH {FLAGS} SELECT 'severity' AS dimension, sev AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'rule', rule, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'evaluation_status', 'FLAGGED', count(*) FROM r")
def anomaly_histograms(spark, sf_dir):
    return anomaly.histograms(_flags(cells(spark, sf_dir)))


@query(f"WITH {FLAGS} SELECT substring(round_key, 1, 10) AS day, count(*) AS n FROM r JOIN cell ON r.cell_id = cell.cell_id GROUP BY ALL ORDER BY day DESC LIMIT 9")
def anomaly_trend(spark, sf_dir):
    c = cells(spark, sf_dir)
    return anomaly.daily_trend(_flags(c), c)


@query("""WITH q AS (
  SELECT upper(substring(event_type, 1, 3)) || '-ZZZ' AS route_id, CASE WHEN event_type = 'view' THEN 'SECOND' WHEN value > 300 THEN 'FIRST' ELSE 'SECOND' END AS provider, ts, event_id, CAST(round(value * 100) AS BIGINT) AS c FROM events
), p AS (
  SELECT route_id, provider, CASE WHEN provider = 'FIRST' THEN arg_min(c, (ts, event_id)) ELSE avg(c) END AS c, CASE WHEN provider = 'FIRST' THEN 1 ELSE count(*) END AS n FROM q GROUP BY route_id, provider
) SELECT route_id, arg_min(provider, provider) AS provider, round(arg_min(c, provider) / 100, 2) AS fare, arg_min(n, provider) AS quote_count FROM p GROUP BY route_id""")
def live_quotes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    provider = F.when(F.col("event_type") == "view", "SECOND").when(F.col("value") > 300, "FIRST").otherwise("SECOND")
    q = e.select(S.route_id(F.upper(F.substring("event_type", 1, 3)), F.lit("ZZZ")).alias("route_id"), provider.alias("provider"), F.col("ts").alias("collected_at"), F.col("event_id").alias("quote_id"), S.cents(F.col("value")).alias("fare_cents"))
    return dashboard.live_quotes(q, {"FIRST": "FIRST", "SECOND": "MEAN"})


CPI = f"""{MONTHS}, t0 AS (
  SELECT a.month, level, ref AS cpi FROM a JOIN b ON a.month = b.month WHERE NOT part AND right(a.month, 2) <> '03'
), t1 AS (
  SELECT *, 100 * level / first_value(level) OVER (ORDER BY month) AS lr, 100 * cpi / first_value(cpi) OVER (ORDER BY month) AS cr FROM t0
), t2 AS (
  SELECT t1.*, 100 * (t1.level / p.level - 1) AS lm, 100 * (t1.cpi / p.cpi - 1) AS cm FROM t1 LEFT JOIN t1 p ON p.month = strftime(CAST(t1.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')
)"""


def _timeline(spark, sf_dir):
    c = comparison(spark, sf_dir)
    p = c.where("level is not null").withColumn("coverage_pct", F.when(F.col("month").endswith("-03"), 79.9).otherwise(80.0))
    return backtest.cpi_timeline(p, c.select("month", F.col("reference_level").alias("cpi")))


@query(f"WITH {CPI} SELECT month, round(lr, 6) AS level_rebased, round(cr, 6) AS cpi_rebased, round(lm, 6) AS level_mom, round(cm, 6) AS cpi_mom, round(lm - cm, 6) AS mom_gap FROM t2")
def cpi_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir).select("month", *[F.round(c, 6).alias(c) for c in ("level_rebased", "cpi_rebased", "level_mom", "cpi_mom", "mom_gap")])


@query(f"""WITH {CPI}, s AS (
  SELECT count(lm) AS n, count(*) AS m, corr(lm, cm) AS p, avg(abs(lm - cm)) AS mae, max(abs(lm - cm)) AS pk, 100 * avg(CASE WHEN lm IS NULL THEN NULL WHEN sign(lm) = sign(cm) THEN 1.0 ELSE 0.0 END) AS d, max(abs(lr - cr)) AS g, 100 * avg(abs(lr - cr) / cr) AS mape FROM t2
), x AS (
  SELECT unnest([{{'metric': 'PEARSON_MOM', 'available': n, 'required': 12, 'v': p}}, {{'metric': 'MEAN_ABSOLUTE_MOM_GAP', 'available': n, 'required': 6, 'v': mae}}, {{'metric': 'PEAK_ABSOLUTE_MOM_GAP', 'available': n, 'required': 1, 'v': pk}}, {{'metric': 'DIRECTIONAL_AGREEMENT', 'available': n, 'required': 6, 'v': d}},
    {{'metric': 'MAXIMUM_LEVEL_GAP', 'available': m, 'required': 1, 'v': g}}, {{'metric': 'MAPE_REBASED_LEVELS', 'available': m, 'required': 6, 'v': mape}}], recursive := true) FROM s
) SELECT metric, available, CAST(required AS BIGINT) AS required, CASE WHEN available >= required THEN round(v, 6) END AS value, CASE WHEN available < required THEN 'INSUFFICIENT_SAMPLE' WHEN v IS NULL THEN 'INSUFFICIENT_VARIATION' ELSE 'AVAILABLE' END AS status FROM x""")
def cpi_comparison(spark, sf_dir):
    return backtest.compare_cpi(_timeline(spark, sf_dir))


@query(f"""WITH {MONTHS} SELECT min(month) FILTER (level IS NOT NULL) AS index_start, max(month) FILTER (level IS NOT NULL) AS index_end, min(month) FILTER (ref IS NOT NULL) AS reference_start, max(month) FILTER (ref IS NOT NULL) AS reference_end,
  min(month) FILTER (match_status = 'MATCHED_COMPLETE_MONTH') AS overlap_start, max(month) FILTER (match_status = 'MATCHED_COMPLETE_MONTH') AS overlap_end, (SELECT count(*) FROM a WHERE NOT part) AS complete_months, count(ref) AS reference_months,
  count(*) FILTER (match_status = 'MATCHED_COMPLETE_MONTH') AS overlapping_levels, greatest(0, count(*) FILTER (match_status = 'MATCHED_COMPLETE_MONTH') - 1) AS overlapping_changes, CASE WHEN count(*) FILTER (match_status = 'MATCHED_COMPLETE_MONTH') > 0 THEN 'OVERLAP_AVAILABLE' ELSE 'NO_OVERLAPPING_COMPLETE_PERIODS' END AS evaluation_status FROM cmp""")
def backtest_summary(spark, sf_dir):
    return backtest.summary(comparison(spark, sf_dir))
