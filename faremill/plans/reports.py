"""Queries over comparisons, lead times and the read API."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest, dashboard, index, validation
from .indexing import ITEMS, event_basket, items
from .roles import QUOTES, RAW, raw_observations, registry, table

QUERIES, ORACLES, query = registry()

# Monthly order value in the role of the index, monthly line value in that of the
# reference series; the last month of either is partial.
MONTHS = """
a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS level, count(*) < 100 AS part FROM orders GROUP BY 1),
b AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, avg(l_extendedprice) AS ref FROM lineitem GROUP BY 1),
cmp AS (
  SELECT coalesce(a.month, b.month) AS month, level, ref, CASE WHEN level IS NULL THEN 'REFERENCE_ONLY' WHEN ref IS NULL THEN 'INDEX_ONLY_NO_REFERENCE_PERIOD' WHEN part THEN 'EXCLUDED_PARTIAL_MONTH' ELSE 'MATCHED_COMPLETE_MONTH' END AS match_status
  FROM a FULL JOIN b ON a.month = b.month
), m0 AS (
  SELECT month, 100 * level / first_value(level) OVER (ORDER BY month) AS a, 100 * ref / first_value(ref) OVER (ORDER BY month) AS b FROM cmp WHERE match_status = 'MATCHED_COMPLETE_MONTH'
), m1 AS (
  SELECT *, 100 * (a / lag(a) OVER (ORDER BY month) - 1) AS da, 100 * (b / lag(b) OVER (ORDER BY month) - 1) AS db FROM m0
), m2 AS (
  SELECT *, rank() OVER (ORDER BY da) + (count(*) OVER (PARTITION BY da) - 1) / 2.0 AS ra, rank() OVER (ORDER BY db) + (count(*) OVER (PARTITION BY db) - 1) / 2.0 AS rb,
    lead(db) OVER (ORDER BY month) AS nb, lag(db) OVER (ORDER BY month) AS pb, lag(da) OVER (ORDER BY month) AS pa FROM m1 WHERE da IS NOT NULL
)"""


def comparison(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = o.groupBy(S.month_id(F.col("o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("level"), (F.count(F.lit(1)) < 100).alias("period_is_partial"))
    b = li.groupBy(S.month_id(F.col("l_shipdate")).alias("month")).agg(F.avg("l_extendedprice").alias("reference_level"))
    return backtest.month_comparison(a, b)


@query(f"WITH {MONTHS} SELECT month, round(level, 4) AS level, round(ref, 4) AS reference_level, match_status FROM cmp")
def month_compare(spark, sf_dir):
    return comparison(spark, sf_dir).select("month", F.round("level", 4).alias("level"), F.round("reference_level", 4).alias("reference_level"), "match_status")


@query(
    f"""WITH {MONTHS}, i AS (
  SELECT *, CAST(substring(month, 1, 4) AS INTEGER) * 12 + CAST(substring(month, 6, 2) AS INTEGER) AS i FROM m1
), y AS (
  SELECT avg(abs(100 * (c.a / p.a - 1) - 100 * (c.b / p.b - 1))) AS yoy FROM i c JOIN i p ON p.i = c.i - 12 WHERE c.da IS NOT NULL
), r AS (
  SELECT count(*) AS n, avg(abs(da - db)) AS mae, sqrt(avg((da - db) * (da - db))) AS rmse, avg(da - db) AS bias, 100 * avg(CASE WHEN sign(da) = sign(db) THEN 1.0 ELSE 0.0 END) AS dir,
    corr(da, db) AS p, corr(ra, rb) AS s, stddev_samp(da) AS sa, stddev_samp(db) AS sb, 100 * avg(CASE WHEN pa IS NULL THEN NULL WHEN (sign(da) * sign(pa) < 0) = (sign(db) * sign(pb) < 0) THEN 1.0 ELSE 0.0 END) AS t, corr(da, pb) AS l1, corr(da, nb) AS l2 FROM m2
), l AS (
  SELECT count(*) AS n, avg(a - b) AS gap, 100 * avg(abs(a - b) / b) AS mape, CAST((SELECT min(i) FROM i WHERE a = (SELECT max(a) FROM i)) - (SELECT min(i) FROM i WHERE b = (SELECT max(b) FROM i)) AS DOUBLE) AS pk FROM i
), x AS (
  SELECT n, unnest([{{'metric': 'MAE', 'required': 6, 'raw': mae}}, {{'metric': 'RMSE', 'required': 6, 'raw': rmse}}, {{'metric': 'BIAS', 'required': 6, 'raw': bias}}, {{'metric': 'DIRECTION', 'required': 6, 'raw': dir}},
    {{'metric': 'PEARSON', 'required': 12, 'raw': p}}, {{'metric': 'SPEARMAN', 'required': 12, 'raw': s}}, {{'metric': 'SD_INDEX', 'required': 12, 'raw': sa}}, {{'metric': 'SD_REFERENCE', 'required': 12, 'raw': sb}}, {{'metric': 'VOLATILITY_RATIO', 'required': 12, 'raw': sa / sb}},
    {{'metric': 'TURNING_AGREEMENT', 'required': 12, 'raw': t}}, {{'metric': 'YOY', 'required': 12, 'raw': yoy}}, {{'metric': 'LEAD_MINUS_1', 'required': 18, 'raw': l1}}, {{'metric': 'LEAD_0', 'required': 18, 'raw': p}}, {{'metric': 'LEAD_PLUS_1', 'required': 18, 'raw': l2}}], recursive := true) FROM r, y
  UNION ALL SELECT n, unnest([{{'metric': 'LEVEL_DIFFERENCE', 'required': 1, 'raw': gap}}, {{'metric': 'MAPE', 'required': 6, 'raw': mape}}, {{'metric': 'PEAK_TIMING', 'required': 12, 'raw': pk}}], recursive := true) FROM l
) SELECT metric, n AS sample, CAST(required AS BIGINT) AS required, CASE WHEN n >= required THEN round(raw, 6) END AS value, CASE WHEN n < required THEN 'INSUFFICIENT_SAMPLE' WHEN raw IS NULL THEN 'UNDEFINED' ELSE 'COMPUTED' END AS status FROM x"""
)
def backtest_metrics(spark, sf_dir):
    return backtest.metrics(backtest.pairs(comparison(spark, sf_dir)))


@query(
    """WITH v AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT v.month, round(v.value, 4) AS value, round(100 * (v.value - m.value) / m.value, 4) AS mom_pct, round(100 * (v.value - y.value) / y.value, 4) AS yoy_pct FROM v
LEFT JOIN v m ON m.month = strftime(CAST(v.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') LEFT JOIN v y ON y.month = strftime(CAST(v.month || '-01' AS DATE) - INTERVAL 12 MONTH, '%Y-%m')"""
)
def calendar_changes(spark, sf_dir):
    v = table(spark, sf_dir, "orders").groupBy(S.month_id(F.col("o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("value"))
    return backtest.calendar_changes(v).withColumn("value", F.round("value", 4))


@query(
    f"""WITH {ITEMS}, p AS (SELECT * FROM idx WHERE variant = 'PRIMARY'), d AS (SELECT DISTINCT CAST(substring(round_sort_key, 1, 10) AS DATE) AS day FROM p),
isl AS (SELECT count(*) AS n, min(day) AS a, max(day) AS b FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM d) GROUP BY g),
gaps AS (SELECT n, date_diff('day', lag(b) OVER (ORDER BY a), a) - 1 AS gap FROM isl),
g AS (
  SELECT 'CONSECUTIVE_DAYS' AS gate, CAST((SELECT max(n) FROM gaps) AS DOUBLE) AS observed, 30.0 AS required UNION ALL SELECT 'ANCHORED_ROUNDS', count(*), 72 FROM p
  UNION ALL SELECT 'COMPLETE_DAILY_ENDS', count(*) FILTER (n >= 3), 24 FROM (SELECT count(*) AS n FROM p GROUP BY substring(round_sort_key, 1, 10))
  UNION ALL SELECT 'ROUTES', max(routes_represented), 12 FROM p UNION ALL SELECT 'BASKET_WEIGHT_PCT', max(coverage_pct), 80 FROM p UNION ALL SELECT 'MATCHED_ITEMS_EVERY_LINK', min(matched_items) FILTER (link_sequence > 0), 30 FROM p
  UNION ALL SELECT 'MATCHED_PER_CONTRIBUTING_ROUTE', coalesce(min(n), 0), 1 FROM comp WHERE variant = 'PRIMARY' UNION ALL SELECT 'VALID_OBSERVATIONS', count(*), 10000 FROM events UNION ALL SELECT 'REAL_DATA', 0, 1
) SELECT gate, observed, CAST(required AS DOUBLE) AS required, observed >= required AS passed FROM g UNION ALL SELECT 'MISSING_DAYS', CAST(coalesce(max(gap), 0) AS DOUBLE), 2.0, coalesce(max(gap), 0) <= 2 FROM gaps"""
)
def production_gates(spark, sf_dir):
    it, basket = items(spark, sf_dir), event_basket(spark, sf_dir)
    n = table(spark, sf_dir, "events").count()
    return backtest.gates(index.round_index(it, basket), basket, index.route_components(it, basket), n, False)


def _lead(spark, sf_dir):
    """Fares by window: quotes whose window follows from the user."""
    windows = F.array(*[F.lit(w[0]) for w in S.WINDOW_BANDS])
    e = table(spark, sf_dir, "events")
    fares = e.select(S.route_id(F.upper(F.substring("event_type", 1, 3)), F.lit("ZZZ")).alias("route_id"), F.element_at(windows, (F.col("user_id") % 5 + 1).cast("int")).alias("advance_purchase_window"), S.cents(F.col("value")).alias("median_cents"))
    return dashboard.lead_time(fares)


LEAD = "lead AS (SELECT upper(substring(event_type, 1, 3)) || '-ZZZ' AS route_id, [1, 7, 15, 30, 45][user_id % 5 + 1] AS days, round(avg(CAST(round(value * 100) AS BIGINT)), 4) AS average_cents, count(*) AS n FROM events GROUP BY 1, 2), mean AS (SELECT days, avg(average_cents) AS a FROM lead GROUP BY days)"


@query(f"WITH {LEAD} SELECT route_id, days, average_cents, n FROM lead")
def lead_time(spark, sf_dir):
    return _lead(spark, sf_dir)


@query(
    f"WITH {LEAD} SELECT route_id, "
    + ", ".join(f"round(avg(average_cents) FILTER (days = {d}), 4) AS t{d}" for d in dashboard.LEAD_DAYS)
    + " FROM (SELECT route_id, days, average_cents FROM lead UNION ALL SELECT 'ALL', days, average_cents FROM lead) GROUP BY route_id"
)
def lead_time_pivot(spark, sf_dir):
    return dashboard.lead_time_pivot(_lead(spark, sf_dir))


@query(
    f"""WITH {LEAD}, s AS (SELECT days, a, lead(days) OVER (ORDER BY days) AS next_days, lead(a) OVER (ORDER BY days) AS b FROM mean), e AS (
  SELECT days, next_days, 100 * (b / a - 1) AS step, ((b - a) / ((a + b) / 2)) / ((next_days - days) / ((days + next_days) / 2.0)) AS el FROM s WHERE next_days IS NOT NULL)
SELECT days, next_days, round(step, 4) AS step_pct, CASE WHEN abs(step) > 15 THEN 'high' WHEN abs(step) > 7 THEN 'medium' ELSE 'low' END AS step_level, round(el, 6) AS elasticity, CASE WHEN abs(el) > 0.4 THEN 'high' WHEN abs(el) > 0.2 THEN 'medium' ELSE 'low' END AS elasticity_level FROM e"""
)
def lead_time_elasticity(spark, sf_dir):
    return dashboard.lead_time_steps(_lead(spark, sf_dir))


@query(f"WITH {LEAD} SELECT arg_min(days, a) AS cheapest_days, arg_max(days, a) AS dearest_days, round(100 * (max(a) FILTER (days = 1) / max(a) FILTER (days = 45) - 1), 4) AS late_premium_pct FROM mean")
def lead_time_extremes(spark, sf_dir):
    return dashboard.lead_time_extremes(_lead(spark, sf_dir))


@query(f"WITH {RAW} SELECT validation_status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM verdicts), 4) AS share_pct FROM verdicts GROUP BY ALL")
def data_quality(spark, sf_dir):
    return dashboard.data_quality(validation.validate(raw_observations(spark, sf_dir)))


@query(f"WITH {RAW}, c AS (SELECT code, count(*) AS n FROM (SELECT unnest(errors) AS code FROM verdicts) GROUP BY code) SELECT code, n, round(100.0 * n / sum(n) OVER (), 4) AS share_pct FROM c ORDER BY n DESC, code LIMIT 8")
def top_issues(spark, sf_dir):
    return dashboard.top_issues(validation.validate(raw_observations(spark, sf_dir)))


@query(f"WITH {ITEMS} SELECT variant, arg_max(link_sequence, link_sequence) AS link_sequence, arg_max(collection_round_id, link_sequence) AS collection_round_id, arg_max(index_level, link_sequence) AS index_level FROM idx GROUP BY variant")
def latest_round(spark, sf_dir):
    rows = index.round_index(items(spark, sf_dir), event_basket(spark, sf_dir))
    return dashboard.latest(rows).select("variant", "link_sequence", "collection_round_id", "index_level")


@query(f"WITH {ITEMS} SELECT variant, route_id, seq AS link_sequence, round(100 * exp(sum(ml) OVER (PARTITION BY variant, route_id ORDER BY seq)), 6) AS route_level FROM comp")
def route_level(spark, sf_dir):
    return dashboard.route_level(index.route_components(items(spark, sf_dir), event_basket(spark, sf_dir)))


@query(f"WITH {ITEMS} SELECT variant, link_sequence, collection_round_id, index_level FROM idx WHERE variant = 'PRIMARY' AND round_sort_key >= '2024-01-05' AND round_sort_key <= '2024-01-20' ORDER BY link_sequence LIMIT 20 OFFSET 10")
def page(spark, sf_dir):
    rows = index.round_index(items(spark, sf_dir), event_basket(spark, sf_dir))
    out, _, _ = dashboard.page(dashboard.filtered(rows, "2024-01-05", "2024-01-20", variant="PRIMARY"), ["link_sequence"], 20, 10)
    return out.select("variant", "link_sequence", "collection_round_id", "index_level")


@query(
    f"""WITH {QUOTES}, h AS (SELECT upper(substring(event_type, 1, 3)) || '-ZZZ' AS route_id, arg_max(CAST(round(value * 100) AS BIGINT), (ts, event_id)) AS last_cents FROM events WHERE event_type <> 'view' GROUP BY 1),
l AS (SELECT upper(substring(event_type, 1, 3)) || '-ZZZ' AS route_id, min(CAST(round(value * 100) AS BIGINT)) AS live_cents FROM events WHERE ts >= TIMESTAMP '2024-01-30 18:00:00' AND event_type IN ('click', 'error') GROUP BY 1),
c AS (SELECT DISTINCT upper(substring(event_type, 1, 3)) || '-ZZZ' AS route_id FROM events)
SELECT c.route_id, coalesce(live_cents, last_cents) AS fare_cents, CASE WHEN live_cents IS NOT NULL THEN 'LIVE' WHEN last_cents IS NOT NULL THEN 'HISTORY' ELSE 'NONE' END AS fare_source FROM c LEFT JOIN h ON c.route_id = h.route_id LEFT JOIN l ON c.route_id = l.route_id"""
)
def route_overview(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", S.route_id(F.upper(F.substring("event_type", 1, 3)), F.lit("ZZZ")).alias("route_id"), S.cents(F.col("value")).alias("c"))
    history = e.where("event_type <> 'view'").select("route_id", F.col("c").alias("median_cents"), F.struct("ts", "event_id").alias("round_sort_key"))
    live = e.where("ts >= timestamp_ntz'2024-01-30 18:00:00' and event_type in ('click', 'error')").select("route_id", F.col("c").alias("fare_cents"))
    return dashboard.route_overview(e.select("route_id").distinct(), history, live).select("route_id", "fare_cents", "fare_source")
