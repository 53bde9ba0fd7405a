"""Queries over full route measures, item states, series reports and page aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import anomaly, backtest, collection, consolidation, dashboard, index, routes, validation
from ..sources import scratch
from .indexing import ITEMS, ROUTED, TRAFFIC, cells, event_basket, grain_a, items, routed
from .reports import MONTHS, comparison
from .roles import QUOTES, RAW, STAGES, quotes, raw_observations, registry, table
from .screening import FLIGHTS, PEERS, POINTS, _rank

QUERIES, ORACLES, query = registry()

BUNDLES = """SELECT cell_id AS consolidation_cell_id, count(*) AS mapped_observations, coalesce(string_agg(observation_id, ';' ORDER BY observation_id) FILTER (cents IS NOT NULL), '') AS contributing_ids,
  coalesce(string_agg(observation_id, ';' ORDER BY observation_id) FILTER (sold), '') AS excluded_sold_out_ids, count(*) FILTER (sold) AS sold_out_in_bundle, string_agg(DISTINCT cell_id || '::FLT::' || flight || '|08:10', ';' ORDER BY cell_id || '::FLT::' || flight || '|08:10') AS flight_cell_ids FROM quotes GROUP BY cell_id"""


@query(f"WITH {QUOTES} {BUNDLES}")
def observation_bundles(spark, sf_dir):
    b = routes.observation_bundles(consolidation.members(quotes(spark, sf_dir)))
    return b.withColumns({n: F.array_join(n, ";") for n in ("contributing_ids", "excluded_sold_out_ids", "flight_cell_ids")})


_KEYS = "r.route_id, r.fare_class, r.round_id"


@query(
    f"""WITH {POINTS}{ROUTED[len(STAGES):]}, rules AS (
  SELECT cell_id, 'R05' AS rule, prior >= 3 AND step IS NOT NULL AS flagged FROM moves WHERE prior < 3 OR step IS NULL OR step > 0.15
  UNION ALL SELECT cell_id, 'R06', FALSE FROM moves WHERE prior < 4 OR l1 = 0 OR l2 = 0 OR l3 = 0 UNION ALL SELECT cell_id, 'R06', TRUE FROM moves WHERE prior >= 4 AND l1 <> 0 AND l2 <> 0 AND l3 <> 0 AND same AND drift > 0.15
  UNION ALL SELECT cell_id, 'R09', TRUE FROM cell WHERE sources <= 1 UNION ALL SELECT cell_id, 'R11', TRUE FROM cell WHERE cents IS NULL UNION ALL SELECT cell_id, 'R12', TRUE FROM cell WHERE alignment <> 'ANCHORED'
), listed AS (
  SELECT {_KEYS}, coalesce(string_agg(DISTINCT rule, ';' ORDER BY rule) FILTER (flagged), '') AS anomaly_rule_ids, coalesce(string_agg(DISTINCT rule, ';' ORDER BY rule) FILTER (NOT flagged), '') AS not_evaluable_rule_ids, count(DISTINCT r.cell_id) FILTER (NOT flagged) AS not_evaluable_cells
  FROM routed r LEFT JOIN rules ON rules.cell_id = r.cell_id GROUP BY {_KEYS}
), obs AS (
  SELECT {_KEYS}, count(*) AS mapped_observations, count(q.cents) AS contributing_observations, count(*) FILTER (sold) AS sold_out_observations, count(DISTINCT r.cell_id || flight) AS flight_cells,
    coalesce(string_agg(observation_id, ';' ORDER BY observation_id) FILTER (q.cents IS NOT NULL), '') AS contributing_observation_ids FROM routed r JOIN quotes q ON q.cell_id = r.cell_id GROUP BY {_KEYS}
), own AS (
  SELECT {_KEYS}, count(*) AS contributing_cells, count(cents) AS priced_cells, count(*) - count(cents) AS unpriced_cells, CAST(floor(median(cents) + 0.5) AS BIGINT) AS median_cents, round((max(cents) - min(cents)) / nullif(min(cents), 0), 6) AS relative_spread,
    count(*) FILTER (sev = 3) AS high_severity_cells, count(*) FILTER (sev = 2) AS review_severity_cells, count(*) FILTER (sev >= 2) AS recommended_review_cells, ['NONE', 'INFO', 'REVIEW', 'HIGH'][max(sev) + 1] AS max_severity,
    string_agg(DISTINCT CASE WHEN sources >= 2 AND priced_flights >= 2 THEN 'COHERENT' ELSE 'ISOLATED' END, ';' ORDER BY CASE WHEN sources >= 2 AND priced_flights >= 2 THEN 'COHERENT' ELSE 'ISOLATED' END) AS market_movement_classes FROM routed r GROUP BY {_KEYS}
) SELECT own.route_id, own.fare_class, own.round_id AS collection_round_id, own.* EXCLUDE (route_id, fare_class, round_id), anomaly_rule_ids, not_evaluable_rule_ids, not_evaluable_cells, mapped_observations, contributing_observations, sold_out_observations, flight_cells, contributing_observation_ids
FROM own JOIN listed USING (route_id, fare_class, round_id) JOIN obs USING (route_id, fare_class, round_id)"""
)
def route_measures(spark, sf_dir):
    c = cells(spark, sf_dir)
    none = F.array().cast("array<string>")
    lists = anomaly.rule_lists(anomaly.series_rules(c).unionByName(anomaly.cell_rules(c)))
    r = routes.route_cells(c, event_basket(spark, sf_dir)).join(lists, "consolidation_cell_id", "left").withColumns({n: F.coalesce(n, none) for n in ("flagged_rules", "not_evaluable_rules")})
    full = routes.full_measures(routes.with_bundles(r, routes.observation_bundles(consolidation.members(quotes(spark, sf_dir)))))
    return full.select(
        "route_id", "fare_class", "collection_round_id", "contributing_cells", "priced_cells", "unpriced_cells", "median_cents", "relative_spread", "high_severity_cells", "review_severity_cells", "recommended_review_cells", "max_severity", "market_movement_classes",
        "anomaly_rule_ids", "not_evaluable_rule_ids", "not_evaluable_cells", "mapped_observations", "contributing_observations", "sold_out_observations", "flight_cells", "contributing_observation_ids",
    )


#: Every third route is outside this basket.
@query(f"WITH {ROUTED} SELECT route_id, fare_class, round_id AS collection_round_id, cells, priced_cells, median_cents FROM grain_a WHERE route_id LIKE 'C%' OR route_id LIKE 'P%'")
def route_off_basket(spark, sf_dir):
    b = event_basket(spark, sf_dir).where("route_id not like 'C%' and route_id not like 'P%'")
    return routes.off_basket(routes.route_cells(cells(spark, sf_dir), b)).select("route_id", "fare_class", "collection_round_id", "cells", "priced_cells", "median_cents")


@query(
    f"""WITH {ITEMS}, s AS (
  SELECT variant, seq, item_id, CASE WHEN prev IS NULL THEN 'ENTERING' WHEN cur IS NULL THEN 'LEAVING' ELSE 'MATCHED' END AS item_status FROM rel
  UNION ALL SELECT i.variant, r.seq, item_id, CASE WHEN status = 'EXCLUDED_REVIEW_HIGH' THEN 'EXCLUDED_ANOMALY' ELSE 'UNPRICED' END FROM items i JOIN rounds r ON i.round_id = r.round_id WHERE status <> 'ELIGIBLE' AND r.seq > 0
) SELECT variant, seq AS link_sequence, item_id, item_status FROM s"""
)
def item_states(spark, sf_dir):
    return index.item_rows(items(spark, sf_dir)).select("variant", "link_sequence", "item_id", "item_status")


@query(
    f"""WITH {POINTS}, f AS (
  SELECT *, prior >= 3 AND step IS NOT NULL AS e5, prior >= 3 AND coalesce(step > 0.15, FALSE) AS f5, prior >= 4 AND l1 <> 0 AND l2 <> 0 AND l3 <> 0 AS e6, prior >= 4 AND l1 <> 0 AND l2 <> 0 AND l3 <> 0 AND same AND drift > 0.15 AS f6, {_rank('step')} IN ('REVIEW', 'HIGH') AS g5, {_rank('drift')} IN ('REVIEW', 'HIGH') AS g6 FROM moves
), p AS (
  SELECT origin, destination, fare_class, count(*) FILTER (e5) AS r05_evaluable, count(*) FILTER (f5) AS r05_flags, count(*) FILTER (e6) AS r06_evaluable, count(*) FILTER (f6) AS r06_flags, count(*) FILTER (f5 AND g5) + count(*) FILTER (f6 AND g6) AS persistent_flags,
    coalesce(string_agg(DISTINCT round_id, ';' ORDER BY round_id) FILTER ((f5 AND g5) OR (f6 AND g6)), '') AS persistent_rounds FROM f GROUP BY ALL
), c AS (
  SELECT origin, destination, fare_class, count(*) AS cells, count(*) FILTER (alignment = 'ANCHORED' AND cents IS NOT NULL) AS anchored_priced_rounds, count(*) FILTER (alignment <> 'ANCHORED') AS unaligned_rounds, count(*) - count(cents) AS no_price_cells FROM cell GROUP BY ALL
) SELECT c.*, coalesce(r05_evaluable, 0) AS r05_evaluable, coalesce(r05_flags, 0) AS r05_flags, coalesce(r06_evaluable, 0) AS r06_evaluable, coalesce(r06_flags, 0) AS r06_flags, coalesce(persistent_flags, 0) AS persistent_flags, coalesce(persistent_rounds, '') AS persistent_rounds,
  CASE WHEN anchored_priced_rounds <= 3 THEN 'INSUFFICIENT_FOR_R05' ELSE 'SUFFICIENT_FOR_R05' END AS history_status FROM c LEFT JOIN p USING (origin, destination, fare_class)"""
)
def series_report(spark, sf_dir):
    return anomaly.series_report(cells(spark, sf_dir)).drop("advance_purchase_window", "travel_date")


@query(
    f"""WITH {FLIGHTS}{PEERS.removeprefix(STAGES)}, h AS (SELECT cell_id, flight FROM fx WHERE k >= 2 AND lo > 0 AND (hi - lo) / nullif(lo, 0) > 0.15), p AS (SELECT cell_id FROM z WHERE abs(z) > 3.5),
parts AS (SELECT *, floor(all_cents * 80 / 100) AS base, floor(all_cents * 15 / 100) AS taxes, CASE WHEN event_id % 11 <> 0 THEN all_cents - floor(all_cents * 80 / 100) - floor(all_cents * 15 / 100) END AS fees FROM quotes),
o AS (SELECT observation_id, count(*) FILTER (cents <= 0) + count(*) FILTER (abs(cents - (base + taxes + fees)) > 100) AS n FROM parts GROUP BY observation_id)
SELECT source, CAST(coalesce(sum(n), 0) AS BIGINT) AS flags, count(*) FILTER (n > 0) AS high_severity_observations, count(DISTINCT h.cell_id || h.flight) AS r07_flight_cells, count(DISTINCT p.cell_id) AS r13_cells
FROM quotes q LEFT JOIN o ON o.observation_id = q.observation_id LEFT JOIN h ON h.cell_id = q.cell_id AND h.flight = q.flight LEFT JOIN p ON p.cell_id = q.cell_id GROUP BY source"""
)
def source_flags(spark, sf_dir):
    """Of fares as they are, which are numbers, so R02 finds none."""
    q = quotes(spark, sf_dir)
    m = consolidation.members(q)
    # Flights and peers read cells eleven times; each would repeat the plan of the kept ones.
    c = scratch.written(cells(spark, sf_dir).select("consolidation_cell_id", *anomaly.PEER, "collection_round_id", "fare_cents", "participating_sources", "priced_flights"), "peers")
    found = anomaly.observation_rules(q).unionByName(anomaly.flight_rules(consolidation.flight_cells(m), c)).unionByName(anomaly.peer_rules(c))
    return anomaly.source_flags(m, found).select("source", "flags", "high_severity_observations", "r07_flight_cells", "r13_cells")


@query(
    f"""WITH {FLIGHTS}, s AS (
  SELECT cell_id, flight, CASE WHEN (k >= 2 AND lo > 0 AND (hi - lo) / nullif(lo, 0) > 0.15) OR (k >= 3 AND worst > 0.15) THEN CASE WHEN coherent THEN 1 ELSE 2 END ELSE 0 END AS f FROM fx
) SELECT q.observation_id, ['NONE', 'INFO', 'REVIEW', 'HIGH'][greatest(f, CASE WHEN cell.sources <= 1 OR cell.cents IS NULL OR cell.alignment <> 'ANCHORED' THEN 1 ELSE 0 END) + 1] AS inherited_severity FROM quotes q JOIN cell ON cell.cell_id = q.cell_id JOIN s ON s.cell_id = q.cell_id AND s.flight = q.flight"""
)
def severity_inherited(spark, sf_dir):
    m, c = consolidation.members(quotes(spark, sf_dir)), cells(spark, sf_dir)
    found = anomaly.flight_rules(consolidation.flight_cells(m), c).unionByName(anomaly.cell_rules(c))
    return anomaly.inherited(m, found).select("observation_id", "inherited_severity")


@query(f"WITH {STAGES} SELECT observation_id, CASE WHEN sold OR event_id % 11 = 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS decomposition_state, CASE WHEN NOT sold AND event_id % 11 <> 0 THEN TRUE END AS decomposition_reconciles FROM quotes")
def observation_decomposition(spark, sf_dir):
    q = quotes(spark, sf_dir)
    return consolidation.with_decomposition(consolidation.members(q), q).select("observation_id", "decomposition_state", "decomposition_reconciles")


@query(
    f"""WITH {ITEMS}, h AS (SELECT variant, seq, route_id, count(*) AS n FROM ok GROUP BY ALL), x AS (
  SELECT i.collection_round_id, b.route_id, i.coverage_pct, round(1 - i.weight_represented, 6) AS weight_missing, coalesce(h.n, 0) AS eligible_items, coalesce(comp.n, 0) > 0 AS relative_available
  FROM idx i CROSS JOIN basket b LEFT JOIN h ON h.variant = i.variant AND h.seq = i.link_sequence AND h.route_id = b.route_id LEFT JOIN comp ON comp.variant = i.variant AND comp.seq = i.link_sequence AND comp.route_id = b.route_id WHERE i.variant = 'PRIMARY'
) SELECT collection_round_id, route_id, p AS coverage_policy_id, eligible_items, relative_available, weight_missing, coverage_pct >= 80 AS coverage_gate_passed, CASE WHEN coverage_pct >= 80 THEN NULL WHEN p = 'SENS-COV-04' THEN 'LOW_COVERAGE_BELOW_80_PERCENT' ELSE 'PARTIAL_COVERAGE_DIAGNOSTIC_ONLY' END AS exclusion_reason
FROM x CROSS JOIN (VALUES ('SENS-COV-01'), ('SENS-COV-02'), ('SENS-COV-03'), ('SENS-COV-04')) v(p)"""
)
def coverage_policies(spark, sf_dir):
    it, b = items(spark, sf_dir), event_basket(spark, sf_dir)
    out = backtest.coverage_policies(index.index_coverage(it, b), index.round_index(it, b))
    return out.select("collection_round_id", "route_id", "coverage_policy_id", "eligible_items", "relative_available", "weight_missing", "coverage_gate_passed", "exclusion_reason")


@query(f"""WITH {TRAFFIC} SELECT route_id, basket_rank, CASE d WHEN 0 THEN split_part(route_id, '-', 1) ELSE split_part(route_id, '-', 2) END AS origin, CASE d WHEN 0 THEN split_part(route_id, '-', 2) ELSE split_part(route_id, '-', 1) END AS destination,
  CAST(CAST('2026-09-01' AS DATE) + days AS VARCHAR) AS travel_date, days AS advance_purchase_days, 'T' || days AS apw_target_code FROM basket, (VALUES (0), (1)) x(d), (VALUES (1), (7), (15), (30), (45)) w(days)""")
def planned_searches(spark, sf_dir):
    return collection.planned_searches(event_basket(spark, sf_dir), "2026-09-01").drop("collection_date").withColumn("travel_date", F.col("travel_date").cast("string"))


@query("SELECT n_name AS route_id, w AS advance_purchase_window, round((1000.0 + n_nationkey) * f, 2) AS average_fare, 2 AS observation_count, 'INR' AS currency FROM nation, (VALUES ('T1', 1.35), ('T7', 1.18), ('T15', 1.0), ('T30', 0.88), ('T45', 0.82)) v(w, f)")
def demo_lead_time(spark, sf_dir):
    return dashboard.demo_curve(table(spark, sf_dir, "nation").select(F.col("n_name").alias("route_id"), (F.col("n_nationkey") + 1000.0).alias("demo_fare")))


@query(
    f"""WITH {ROUTED}, e AS (SELECT route_id, round_key, avg(median_cents) AS a, min(min_cents) AS lo, max(max_cents) AS hi, max(sev) AS s FROM grain_a GROUP BY ALL), w AS (
  SELECT *, lag(a) OVER (PARTITION BY route_id ORDER BY round_key) AS p, lead(round_key) OVER (PARTITION BY route_id ORDER BY round_key) AS nx, max(s) OVER (PARTITION BY route_id) AS top FROM e
) SELECT route_id, round_key AS round_sort_key, round(a, 4) AS average_cents, round(p, 4) AS previous_cents, lo AS observed_min, hi AS observed_max, round(100 * (a / p - 1), 2) AS change_pct, ['NONE', 'INFO', 'REVIEW', 'HIGH'][top + 1] AS severity FROM w WHERE nx IS NULL"""
)
def route_changes(spark, sf_dir):
    out = dashboard.route_changes(grain_a(spark, sf_dir))
    return out.withColumns({n: F.round(n, 4) for n in ("average_cents", "previous_cents")})


@query(f"WITH {RAW} SELECT count(*) AS records, count(*) FILTER (len(errors) = 0 AND validation_status <> 'INVALID') AS valid_records, count(*) FILTER (len(errors) > 0) AS records_with_errors, count(*) FILTER (len(list_filter(errors, lambda x: x LIKE 'MISSING%')) > 0) AS records_with_missing, round(100.0 * count(*) FILTER (len(errors) = 0) / count(*), 2) AS valid_pct FROM verdicts")
def validation_totals(spark, sf_dir):
    return dashboard.validation_totals(validation.validate(raw_observations(spark, sf_dir)))


@query(f"""WITH {RAW}, d AS (SELECT strftime(CAST(o_orderdate AS DATE) + 5000, '%Y-%m-%d') AS day, validation_status <> 'INVALID' AS ok FROM verdicts v JOIN orders ON o_orderkey = CAST(split_part(observation_id, '-', 1) AS BIGINT) WHERE timed)
SELECT day, count(*) AS records, count(*) FILTER (ok) AS valid_records, round(100.0 * count(*) FILTER (ok) / count(*), 4) AS quality_pct FROM d GROUP BY day ORDER BY day DESC LIMIT 30""")
def quality_trend(spark, sf_dir):
    return dashboard.quality_trend(validation.validate(raw_observations(spark, sf_dir)))


@query("SELECT upper(substring(event_type, 1, 3)) || '-ZZZ' AS route_id, min(CAST(round(value * 100) AS BIGINT)) AS minimum_cents, round(avg(CAST(round(value * 100) AS BIGINT)), 2) AS average_cents, max(CAST(round(value * 100) AS BIGINT)) AS maximum_cents, count(*) AS quote_count FROM events WHERE round(value * 100) > 0 AND event_id % 3 <> 0 GROUP BY 1")
def quote_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "unverified").otherwise("verified")
    return dashboard.quote_ranges(e.select(S.route_id(F.upper(F.substring("event_type", 1, 3)), F.lit("ZZZ")).alias("route_id"), S.cents(F.col("value")).alias("fare_cents"), F.lit("INR").alias("currency"), status.alias("price_status")))


@query(f"""WITH {ITEMS}, d AS (SELECT variant, substring(round_sort_key, 1, 10) AS day, arg_max(index_level, round_sort_key) AS level FROM idx GROUP BY ALL), c AS (
  SELECT *, 100 * (level / lag(level) OVER (PARTITION BY variant ORDER BY day) - 1) AS x FROM d
) SELECT variant, day, level, CASE WHEN x IS NULL THEN NULL WHEN abs(x) < 0.05 THEN 'Stable' WHEN x > 0 THEN 'Rising' ELSE 'Falling' END AS trend FROM c""")
def daily_levels(spark, sf_dir):
    from pyspark.sql import Window

    days = dashboard.last_of_day(index.round_index(items(spark, sf_dir), event_basket(spark, sf_dir)))
    change = 100 * S.relative_change(F.lag("level").over(Window.partitionBy("variant").orderBy("day")), F.col("level"))
    return days.withColumn("_x", change).withColumn("trend", F.when(F.col("_x").isNotNull(), dashboard.trend(F.col("_x")))).drop("_x")


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 31 GROUP BY event_type")
def look_back(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("day"))
    return dashboard.look_back(e, "day", "1M").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MONTHS} SELECT 'LINE_VALUE' AS reference_series_id, 'PRICE' AS classification, min(month) AS date_start, max(month) AS date_end, count(*) AS observation_count, count(*) - count(ref) AS missing_value_count, TRUE AS valid_comparison_target, 'MONTHLY_COMPLETE_ONLY' AS valid_comparison_grains FROM b""")
def reference_metadata(spark, sf_dir):
    series = comparison(spark, sf_dir).where("reference_level is not null").select("month", F.col("reference_level").alias("value"))
    return backtest.reference_metadata(series, "LINE_VALUE", True)


@query(f"""WITH {MONTHS}, s AS (SELECT month, match_status, 'INDEX' AS input_role, level AS v FROM cmp WHERE level IS NOT NULL UNION ALL SELECT month, match_status, 'REFERENCE', ref FROM cmp WHERE ref IS NOT NULL)
SELECT metric, input_role, month AS period_id, round(v, 4) AS source_value, CASE WHEN match_status <> 'MATCHED_COMPLETE_MONTH' THEN match_status END AS exclusion, CASE WHEN match_status = 'MATCHED_COMPLETE_MONTH' THEN 'RESOLVED' ELSE 'BLOCKED_INPUT_TRACED' END AS lineage_status
FROM s, (SELECT unnest({list(backtest.MINIMUM)}) AS metric) m""")
def metric_lineage(spark, sf_dir):
    c = comparison(spark, sf_dir)
    return backtest.metric_lineage(backtest.metrics(backtest.pairs(c)), c).withColumn("source_value", F.round("source_value", 4))


_PAYLOAD = """concat('{"content":{"results":{"itineraries":{"direct":{"legIds":["l0"],"pricingOptions":[{"id":"o1","agentIds":["a1"],"price":{"amount":"', cents, '","unit":"PRICE_UNIT_CENTI"},"pricingOptionFare":{"brandNames":["Saver"]},"items":[]},',
  '{"id":"o2","agentIds":["a2"],"items":[{"agentId":"a1","price":{"amount":"', event_id, '","unit":"PRICE_UNIT_WHOLE"}},{"agentId":"gone","price":{"amount":"x","unit":"PRICE_UNIT_WHOLE"}}]}]},"return":{"legIds":["l0","l0"],"pricingOptions":[]}},',
  '"legs":{"l0":{"stopCount":', user_id % 2, ',"segmentIds":["s0"]}},"segments":{"s0":{"marketingCarrierId":"c0","marketingFlightNumber":"', user_id, '","departureDateTime":{"year":2026,"month":9,"day":', event_id % 32, ',"hour":8}}},"carriers":{"c0":{"iata":"ZZ","name":"Zed"}},"agents":{"a1":{"name":"First"}}}}}')"""


@query("""WITH e AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN event_id % 32 BETWEEN 1 AND 30 THEN '2026-09-' || lpad(CAST(event_id % 32 AS VARCHAR), 2, '0') || 'T08:00:00' END AS departure_at FROM events WHERE user_id % 2 = 0)
SELECT event_id AS query_id, 'direct' AS itinerary_id, 'o1' AS pricing_option_id, 'a1' AS agent_id, 'First' AS agent, cents / 100 AS total_fare, 'Saver' AS fare_class_raw, 'Economy Saver' AS fare_class, 'ZZ' AS carrier_code, CAST(user_id AS VARCHAR) AS flight_number, departure_at FROM e WHERE cents > 0
UNION ALL SELECT event_id, 'direct', 'o2', 'a1', 'First', event_id, 'ECONOMY_UNCLASSIFIED', 'ECONOMY_UNCLASSIFIED', 'ZZ', CAST(user_id AS VARCHAR), departure_at FROM e WHERE event_id > 0""")
def itinerary_offers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cents", S.cents(F.col("value")))
    payloads = e.select(F.col("event_id").alias("query_id"), F.col("ts").alias("collected_at"), F.expr(_PAYLOAD).alias("payload"))
    o = collection.itinerary_offers(payloads, {"Saver": "Economy Saver"}, ("Economy Saver",))
    return o.select("query_id", "itinerary_id", "pricing_option_id", "agent_id", "agent", F.col("total_fare").cast("double").alias("total_fare"), "fare_class_raw", "fare_class", "carrier_code", "flight_number", "departure_at")
