"""Queries over baskets, routes and the chained index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import basket, consolidation, index, routes
from .roles import RAW, STAGES, kept, quotes, raw_observations, registry, table

QUERIES, ORACLES, query = registry()


def cells(spark, sf_dir):
    """Consolidated quotes; a wide range within a cell stands for its severity."""
    out = consolidation.cells(consolidation.members(quotes(spark, sf_dir)))
    severity = F.when(F.col("max_cents") > 2 * F.col("min_cents"), "HIGH").when(F.col("max_cents") > 1.5 * F.col("min_cents"), "REVIEW").otherwise("NONE")
    return kept(spark, sf_dir, "cells", lambda: out.withColumn("severity", severity))


def traffic(spark, sf_dir):
    """Events by route, and a route that no event serves."""
    code = F.upper(F.substring("event_type", 1, 3))
    seen = table(spark, sf_dir, "events").groupBy(S.route_id(code, F.lit("ZZZ")).alias("route_id")).agg(F.count(F.lit(1)).alias("passengers"))
    return seen.unionByName(spark.range(1).select(F.lit("QQQ-WWW").alias("route_id"), F.lit(100).cast("long").alias("passengers")))


def event_basket(spark, sf_dir):
    return kept(spark, sf_dir, "basket", lambda: routes.fixed(basket.weighted(traffic(spark, sf_dir))), persist=False)


def routed(spark, sf_dir):
    return routes.route_cells(cells(spark, sf_dir), event_basket(spark, sf_dir))


def grain_a(spark, sf_dir):
    """Read by every index table, several times by some, hence kept."""
    return kept(spark, sf_dir, "grain_a", lambda: routes.grain_a(routed(spark, sf_dir), event_basket(spark, sf_dir)))


def items(spark, sf_dir):
    return index.eligible(grain_a(spark, sf_dir))


TRAFFIC = """
traffic AS (
  SELECT upper(substring(event_type, 1, 3)) || '-ZZZ' AS route_id, count(*) AS passengers FROM events GROUP BY 1 UNION ALL SELECT 'QQQ-WWW', 100
), w0 AS (
  SELECT *, row_number() OVER (ORDER BY passengers DESC, route_id) AS basket_rank, passengers / sum(passengers) OVER () AS full_weight, CAST(round(passengers / sum(passengers) OVER () * 1000000) AS BIGINT) AS micro FROM traffic
), basket AS (
  SELECT route_id, passengers, basket_rank, full_weight, CASE WHEN basket_rank = 1 THEN 1000000 - sum(micro) OVER () ELSE 0 END AS residual,
    (micro + CASE WHEN basket_rank = 1 THEN 1000000 - sum(micro) OVER () ELSE 0 END) / 1000000.0 AS weight FROM w0
)"""

ROUTED = (
    STAGES
    + ", "
    + TRAFFIC
    + """, routed AS (
  SELECT *, least(origin, destination) || '-' || greatest(origin, destination) AS route_id, origin || '-' || destination AS pair,
    CASE WHEN max_cents > 2 * min_cents THEN 3 WHEN max_cents > 1.5 * min_cents THEN 2 ELSE 0 END AS sev FROM cell
), src AS (
  SELECT DISTINCT least(origin, destination) || '-' || greatest(origin, destination) AS route_id, fare_class, round_id, source FROM quotes WHERE cents IS NOT NULL
), grain_a AS (
  SELECT r.route_id, r.fare_class, r.round_id, any_value(alignment) AS alignment, any_value(round_key) AS round_key, count(*) AS cells, count(cents) AS priced_cells,
    CAST(floor(median(cents) + 0.5) AS BIGINT) AS median_cents, min(cents) AS min_cents, max(cents) AS max_cents, CAST(sum(observations) AS BIGINT) AS observations, count(DISTINCT pair) AS pairs, max(sev) AS sev,
    (SELECT count(DISTINCT source) FROM src s WHERE s.route_id = r.route_id AND s.fare_class = r.fare_class AND s.round_id = r.round_id) AS sources
  FROM routed r GROUP BY r.route_id, r.fare_class, r.round_id
)"""
)

ITEMS = (
    ROUTED
    + """, rounds AS (
  SELECT round_id, round_key, row_number() OVER (ORDER BY round_key) - 1 AS seq, lag(round_id) OVER (ORDER BY round_key) AS prev FROM (SELECT DISTINCT round_id, round_key FROM grain_a WHERE alignment = 'ANCHORED')
), items AS (
  SELECT v.variant, g.*, 'ITEM::' || route_id || '|' || fare_class || '|T45(40-50)|2024-03-01' AS item_id,
    CASE WHEN median_cents IS NULL THEN 'NOT_PRICED' WHEN median_cents <= 0 THEN 'NON_POSITIVE_FARE' WHEN v.variant = 'EXCL_REVIEW_HIGH' AND sev >= 2 THEN 'EXCLUDED_REVIEW_HIGH' ELSE 'ELIGIBLE' END AS status
  FROM grain_a g, (VALUES ('PRIMARY'), ('EXCL_REVIEW_HIGH')) v(variant)
), ok AS (
  SELECT variant, seq, item_id, items.route_id, median_cents AS c FROM items JOIN rounds ON items.round_id = rounds.round_id WHERE status = 'ELIGIBLE'
), rel AS (
  SELECT coalesce(n.variant, p.variant) AS variant, coalesce(n.seq, p.seq + 1) AS seq, coalesce(n.item_id, p.item_id) AS item_id, coalesce(n.route_id, p.route_id) AS route_id, n.c AS cur, p.c AS prev
  FROM (SELECT * FROM ok WHERE seq > 0) n FULL JOIN ok p ON n.variant = p.variant AND n.seq = p.seq + 1 AND n.item_id = p.item_id
  WHERE coalesce(n.seq, p.seq + 1) <= (SELECT max(seq) FROM ok)
), comp AS (
  SELECT *, weight / sum(weight) OVER (PARTITION BY variant, seq) AS nw FROM (
    SELECT variant, seq, rel.route_id, count(*) AS n, avg(ln(cur / prev)) AS ml, any_value(CAST(weight AS DOUBLE)) AS weight FROM rel JOIN basket ON rel.route_id = basket.route_id WHERE cur IS NOT NULL AND prev IS NOT NULL GROUP BY variant, seq, rel.route_id)
), link AS (
  SELECT variant, seq, sum(nw * ml) AS lf, sum(n) AS matched, count(*) AS routes, sum(weight) AS weight FROM comp GROUP BY ALL
), base AS (
  SELECT variant, count(*) AS routes, sum(weight) AS weight FROM (SELECT DISTINCT variant, ok.route_id, CAST(weight AS DOUBLE) AS weight FROM ok JOIN basket ON ok.route_id = basket.route_id WHERE seq = 0) GROUP BY variant
), chain AS (
  SELECT v.variant, r.seq, r.round_id, r.round_key, r.prev, exp(lf) AS f, matched,
    100 * exp(sum(coalesce(lf, 0)) OVER (PARTITION BY v.variant ORDER BY r.seq)) AS level,
    coalesce(CASE WHEN r.seq = 0 THEN base.routes ELSE link.routes END, 0) AS routes, coalesce(CASE WHEN r.seq = 0 THEN base.weight ELSE link.weight END, 0) AS weight
  FROM rounds r CROSS JOIN (VALUES ('PRIMARY'), ('EXCL_REVIEW_HIGH')) v(variant) LEFT JOIN link ON link.variant = v.variant AND link.seq = r.seq LEFT JOIN base ON base.variant = v.variant
), idx AS (
  SELECT variant, seq AS link_sequence, round_id AS collection_round_id, round_key AS round_sort_key, round(f, 8) AS chain_factor, round(level, 6) AS index_level,
    round(100 * (level - lag(level) OVER (PARTITION BY variant ORDER BY seq)) / lag(level) OVER (PARTITION BY variant ORDER BY seq), 4) AS pct_change,
    CAST(coalesce(matched, 0) AS BIGINT) AS matched_items, routes AS routes_represented, round(weight, 6) AS weight_represented, round(100 * weight, 4) AS coverage_pct,
    CASE WHEN routes <= 0 THEN 'NO_BASKET_COVERAGE' WHEN routes = (SELECT count(*) FROM basket) THEN 'FULL_BASKET_COVERAGE' ELSE 'PARTIAL_COVERAGE_PROTOTYPE' END AS coverage_status FROM chain
)"""
)


@query(f"WITH {TRAFFIC} SELECT route_id, passengers, basket_rank AS traffic_rank, CAST(sum(passengers) OVER (ORDER BY basket_rank) AS BIGINT) AS running_passengers, round(100.0 * sum(passengers) OVER (ORDER BY basket_rank) / sum(passengers) OVER (), 4) AS cumulative_pct FROM basket")
def basket_rank(spark, sf_dir):
    return basket.ranked(traffic(spark, sf_dir))


@query(f"WITH {TRAFFIC} SELECT route_id, passengers, basket_rank, round(full_weight, 12) AS full_weight, CAST(residual AS BIGINT) AS residual_micro, CAST(weight AS DOUBLE) AS traffic_weight FROM basket")
def basket_weights(spark, sf_dir):
    return event_basket(spark, sf_dir).select("route_id", "passengers", "basket_rank", F.round("full_weight", 12).alias("full_weight"), "residual_micro", F.col("traffic_weight").cast("double").alias("traffic_weight"))


@query(f"WITH {TRAFFIC} SELECT n AS basket_size, CAST(sum(passengers) AS BIGINT) AS passengers, round(100.0 * sum(passengers) / (SELECT sum(passengers) FROM basket), 4) AS covered_pct FROM basket JOIN (VALUES (2), (4), (10)) s(n) ON basket_rank <= n GROUP BY n")
def basket_sizes(spark, sf_dir):
    return basket.size_analysis(basket.ranked(traffic(spark, sf_dir)), (2, 4, 10))


def nation_traffic(spark, sf_dir):
    """Traffic between nations: orders of a customer's lines by supplier's nation."""
    pairs = raw_observations(spark, sf_dir).withColumn("route_id", S.route_id(F.col("origin"), F.col("destination"))).where("route_id is not null").groupBy("route_id").agg(F.count(F.lit(1)).alias("passengers"))
    return basket.ranked(pairs)


@query(f"""WITH RECURSIVE {RAW}, ends AS (SELECT 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS a, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS b FROM raw WHERE s_nationkey <> c_nationkey),
place AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, CAST(n_regionkey AS VARCHAR) AS region FROM nation),
pair AS (SELECT least(a, b) AS c1, greatest(a, b) AS c2, count(*) AS n FROM ends GROUP BY ALL),
rk AS MATERIALIZED (SELECT c1 || '-' || c2 AS route_id, c1, c2, p.region AS r1, q.region AS r2, row_number() OVER (ORDER BY n DESC, c1, c2) AS k FROM pair JOIN place p ON p.code = c1 JOIN place q ON q.code = c2),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, 0 AS n, CAST([] AS VARCHAR[]) AS regions, CAST([] AS VARCHAR[]) AS cities, CAST(NULL AS VARCHAR) AS stage
  UNION ALL SELECT k, n + CASE WHEN stage IS NULL THEN 0 ELSE 1 END, CASE WHEN stage IS NULL THEN regions ELSE regions || [r1, r2] END, CASE WHEN stage IS NULL THEN cities ELSE cities || [c1, c2] END, stage FROM (
    SELECT rk.*, w.n, w.regions, w.cities, CASE WHEN w.n < 10 THEN 'TOP_TRAFFIC' WHEN w.n < 15 AND NOT list_has_all(w.regions, [r1, r2]) THEN 'NEW_REGION' END AS stage FROM walk w JOIN rk ON rk.k = w.k + 1)
), passed AS MATERIALIZED (SELECT rk.*, row_number() OVER (ORDER BY rk.k) AS j FROM rk JOIN walk ON walk.k = rk.k WHERE stage IS NULL),
again AS (
  SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS k, max(n) AS n, arg_max(cities, k) AS cities, CAST(NULL AS VARCHAR) AS stage FROM walk
  UNION ALL SELECT j, k, n + CASE WHEN stage IS NULL THEN 0 ELSE 1 END, CASE WHEN stage IS NULL THEN cities ELSE cities || [c1, c2] END, stage FROM (
    SELECT p.*, g.n, g.cities, CASE WHEN g.n < 15 AND NOT list_has_all(g.cities, [c1, c2]) THEN 'NEW_CITY' END AS stage FROM again g JOIN passed p ON p.j = g.j + 1)
) SELECT route_id, stage AS selection_stage, CAST(row_number() OVER (ORDER BY t.k) AS INTEGER) AS basket_rank FROM (SELECT k, stage FROM walk WHERE stage IS NOT NULL UNION ALL SELECT k, stage FROM again WHERE stage IS NOT NULL) t JOIN rk ON rk.k = t.k""")
def basket_diversified(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.col("n_regionkey").cast("string").alias("region"))
    r = nation_traffic(spark, sf_dir).withColumns({"city_1": F.substring("route_id", 1, 3), "city_2": F.substring("route_id", 5, 3)})
    for k in ("1", "2"):
        r = r.join(F.broadcast(nation.select(F.col("code").alias(f"city_{k}"), F.col("region").alias(f"region_{k}"))), f"city_{k}")
    return basket.diversified(r)


@query(f"WITH {ROUTED} SELECT cell_id AS consolidation_cell_id, route_id, pair AS directed_pair, CASE WHEN pair = route_id THEN 'EXACT_KEY_MATCH' ELSE 'CANONICALIZED_FROM_REVERSE' END AS direction_relation FROM routed")
def route_canonical(spark, sf_dir):
    return routed(spark, sf_dir).select("consolidation_cell_id", "route_id", "directed_pair", "direction_relation")


_GRAIN = "cells, priced_cells, median_cents, min_cents, max_cents, observations, sources, pairs AS directed_pairs, ['NONE', 'INFO', 'REVIEW', 'HIGH'][sev + 1] AS max_severity"
_OUT = ("cells", "priced_cells", "median_cents", "min_cents", "max_cents", "observations", "sources", "directed_pairs", "max_severity")
_IDLE = "0, 0, NULL, NULL, NULL, 0, 0, 0, NULL"


@query(f"WITH {ROUTED} SELECT route_id, fare_class, round_id AS collection_round_id, {_GRAIN} FROM grain_a UNION ALL SELECT route_id, NULL, NULL, {_IDLE} FROM basket WHERE route_id = 'QQQ-WWW'")
def route_grain_a(spark, sf_dir):
    return grain_a(spark, sf_dir).select("route_id", "fare_class", "collection_round_id", *_OUT)


@query(
    f"""WITH {ROUTED}, s AS (SELECT route_id, fare_class, round_id, count(DISTINCT source) AS sources FROM src GROUP BY ALL)
SELECT r.route_id, r.fare_class, r.round_id AS collection_round_id, count(*) AS cells, count(cents) AS priced_cells, CAST(floor(median(cents) + 0.5) AS BIGINT) AS median_cents FROM routed r GROUP BY r.route_id, r.fare_class, r.round_id
UNION ALL SELECT 'QQQ-WWW', NULL, NULL, 0, 0, NULL"""
)
def route_grain_b(spark, sf_dir):
    return routes.grain_b(routed(spark, sf_dir), event_basket(spark, sf_dir)).select("route_id", "fare_class", "collection_round_id", "cells", "priced_cells", "median_cents")


@query(f"WITH {ROUTED} SELECT route_id, pair AS directed_pair, CASE WHEN pair = route_id THEN 'EXACT_KEY_MATCH' ELSE 'CANONICALIZED_FROM_REVERSE' END AS direction_relation, count(*) AS cells, CAST(sum(observations) AS BIGINT) AS observations FROM routed GROUP BY ALL UNION ALL SELECT 'QQQ-WWW', NULL, 'NO_OBSERVATIONS', 0, 0")
def route_crosswalk(spark, sf_dir):
    return routes.crosswalk(routed(spark, sf_dir), event_basket(spark, sf_dir)).drop("in_basket")


@query(
    f"""WITH {ROUTED} SELECT b.route_id, b.basket_rank, count(r.cell_id) AS cells, count(r.cents) AS priced_cells, CAST(floor(median(r.cents) + 0.5) AS BIGINT) AS median_cents, count(DISTINCT round_id) AS rounds,
  CASE WHEN count(r.cell_id) = 0 THEN 'NO_OBSERVATIONS' WHEN bool_and(pair = b.route_id) THEN 'OBSERVED' ELSE 'OBSERVED_VIA_CANONICAL_KEY' END AS coverage_status
FROM basket b LEFT JOIN routed r ON r.route_id = b.route_id GROUP BY b.route_id, b.basket_rank"""
)
def route_coverage(spark, sf_dir):
    return routes.coverage(routed(spark, sf_dir), event_basket(spark, sf_dir)).select("route_id", "basket_rank", "cells", "priced_cells", "median_cents", "rounds", "coverage_status")


@query(f"WITH {ITEMS} SELECT variant, seq AS link_sequence, item_id, route_id, cur AS current_cents, prev AS previous_cents, CASE WHEN prev IS NULL THEN 'ENTERING' WHEN cur IS NULL THEN 'LEAVING' ELSE 'MATCHED' END AS item_status, round(cur / prev, 8) AS price_relative FROM rel")
def item_relatives(spark, sf_dir):
    return index.item_relatives(items(spark, sf_dir)).withColumn("price_relative", F.round("price_relative", 8))


@query(f"WITH {ITEMS} SELECT variant, seq AS link_sequence, count(*) FILTER (prev IS NULL) AS entering_items, count(*) FILTER (cur IS NULL) AS leaving_items, count(*) FILTER (cur IS NOT NULL AND prev IS NOT NULL) AS matched_items FROM rel GROUP BY ALL")
def entering_leaving(spark, sf_dir):
    n = lambda s: F.count_if(F.col("item_status") == s).alias(f"{s.lower()}_items")
    return index.item_relatives(items(spark, sf_dir)).groupBy("variant", "link_sequence").agg(n("ENTERING"), n("LEAVING"), n("MATCHED"))


@query(f"WITH {ITEMS} SELECT variant, seq AS link_sequence, route_id, n AS matched_items, round(exp(ml), 8) AS route_index, round(nw, 10) AS normalized_weight, round(nw * ml, 10) AS log_contribution FROM comp")
def route_jevons(spark, sf_dir):
    c = index.route_components(items(spark, sf_dir), event_basket(spark, sf_dir))
    return c.select("variant", "link_sequence", "route_id", "matched_items", F.round("route_index", 8).alias("route_index"), F.round("normalized_weight", 10).alias("normalized_weight"), F.round("log_contribution", 10).alias("log_contribution"))


_INDEX = ("variant", "link_sequence", "collection_round_id", "round_sort_key", "chain_factor", "index_level", "pct_change", "matched_items", "routes_represented", "weight_represented", "coverage_pct", "coverage_status")


@query(f"WITH {ITEMS} SELECT * FROM idx")
def round_index(spark, sf_dir):
    return index.round_index(items(spark, sf_dir), event_basket(spark, sf_dir)).select(*_INDEX)


@query(
    f"""WITH {ITEMS}, t AS (
  SELECT *, 'DAILY' AS period_grain, substring(round_sort_key, 1, 10) AS period_id, 3 AS expected FROM idx
  UNION ALL SELECT *, 'WEEKLY', strftime(CAST(substring(round_sort_key, 1, 10) AS DATE), '%G-W%V'), 21 FROM idx
  UNION ALL SELECT *, 'MONTHLY', substring(round_sort_key, 1, 7), 3 * date_part('day', last_day(CAST(substring(round_sort_key, 1, 10) AS DATE))) FROM idx)
SELECT variant, period_grain, period_id, arg_max(index_level, link_sequence) AS end_level, round(avg(index_level), 6) AS mean_level, count(*) AS rounds, CAST(sum(matched_items) AS BIGINT) AS matched_items, count(*) < max(expected) AS period_is_partial,
  CASE WHEN bool_or(coverage_status = 'PARTIAL_COVERAGE_PROTOTYPE') THEN 'PARTIAL_COVERAGE_PROTOTYPE' ELSE arg_min(coverage_status, link_sequence) END AS coverage_status FROM t GROUP BY variant, period_grain, period_id"""
)
def period_index(spark, sf_dir):
    p = index.period_index(index.round_index(items(spark, sf_dir), event_basket(spark, sf_dir)))
    return p.select("variant", "period_grain", "period_id", "end_level", "mean_level", "rounds", "matched_items", "period_is_partial", "coverage_status")


@query(
    f"""WITH {ITEMS}, h AS (SELECT variant, seq, route_id, count(*) AS n FROM ok GROUP BY ALL)
SELECT v.variant, r.seq AS link_sequence, b.route_id, coalesce(h.n, 0) AS eligible_items, coalesce(comp.n, 0) AS matched_items, CASE WHEN r.seq = 0 THEN coalesce(h.n, 0) > 0 ELSE coalesce(comp.n, 0) > 0 END AS contributes
FROM rounds r CROSS JOIN basket b CROSS JOIN (VALUES ('PRIMARY'), ('EXCL_REVIEW_HIGH')) v(variant)
LEFT JOIN h ON h.variant = v.variant AND h.seq = r.seq AND h.route_id = b.route_id LEFT JOIN comp ON comp.variant = v.variant AND comp.seq = r.seq AND comp.route_id = b.route_id"""
)
def index_coverage(spark, sf_dir):
    return index.index_coverage(items(spark, sf_dir), event_basket(spark, sf_dir)).select("variant", "link_sequence", "route_id", "eligible_items", "matched_items", "contributes")


@query(f"WITH {ITEMS} SELECT rel.variant, rel.seq AS link_sequence, item_id, round(nw / n, 10) AS contribution_weight FROM rel JOIN comp ON rel.variant = comp.variant AND rel.seq = comp.seq AND rel.route_id = comp.route_id WHERE cur IS NOT NULL AND prev IS NOT NULL")
def index_lineage(spark, sf_dir):
    return index.index_lineage(items(spark, sf_dir), event_basket(spark, sf_dir)).select("variant", "link_sequence", "item_id", F.round("contribution_weight", 10).alias("contribution_weight"))


@query(
    f"""WITH {ITEMS}, stray AS (SELECT DISTINCT variant, round_id, round_key FROM items WHERE alignment = 'UNALIGNED'),
near AS (SELECT s.variant, s.round_id AS stray_id, arg_min(r.round_id, (abs(date_diff('minute', strptime(s.round_key, '%Y-%m-%d %H:%M'), strptime(r.round_key, '%Y-%m-%d %H:%M'))), r.round_key)) AS nearest_round_id,
  min(abs(date_diff('minute', strptime(s.round_key, '%Y-%m-%d %H:%M'), strptime(r.round_key, '%Y-%m-%d %H:%M')))) AS minutes_apart FROM stray s, rounds r GROUP BY s.variant, s.round_id),
have AS (SELECT variant, round_id, item_id FROM items WHERE status = 'ELIGIBLE')
SELECT near.variant, stray_id, nearest_round_id, minutes_apart, count(m.item_id) AS items, count(t.item_id) AS items_in_nearest FROM near LEFT JOIN have m ON m.variant = near.variant AND m.round_id = stray_id
LEFT JOIN have t ON t.variant = near.variant AND t.round_id = nearest_round_id AND t.item_id = m.item_id GROUP BY ALL"""
)
def nearest_round(spark, sf_dir):
    return index.unaligned_diagnostics(items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT variant, link_sequence, index_level, round(100 * index_level / max(CASE WHEN link_sequence = 5 THEN index_level END) OVER (PARTITION BY variant), 6) AS rebased_level FROM idx")
def rebase(spark, sf_dir):
    rows = index.round_index(items(spark, sf_dir), event_basket(spark, sf_dir))
    return index.rebased(rows, F.col("link_sequence") == 5).select("variant", "link_sequence", "index_level", "rebased_level")


@query(
    f"""WITH {ITEMS}, l AS (SELECT variant, seq, avg(ml) AS lf FROM comp GROUP BY ALL)
SELECT v.variant, r.seq AS link_sequence, round(100 * exp(sum(coalesce(lf, 0)) OVER (PARTITION BY v.variant ORDER BY r.seq)), 6) AS equal_route_level FROM rounds r CROSS JOIN (VALUES ('PRIMARY'), ('EXCL_REVIEW_HIGH')) v(variant) LEFT JOIN l ON l.variant = v.variant AND l.seq = r.seq"""
)
def equal_route_chain(spark, sf_dir):
    return index.equal_route_chain(items(spark, sf_dir), event_basket(spark, sf_dir)).drop("collection_round_id")


@query(
    f"""WITH {ITEMS}, l AS (SELECT variant, seq, sum(weight * ml) AS lf FROM comp GROUP BY ALL)
SELECT v.variant, r.seq AS link_sequence, round(100 * exp(sum(coalesce(lf, 0)) OVER (PARTITION BY v.variant ORDER BY r.seq)), 6) AS locked_weight_level FROM rounds r CROSS JOIN (VALUES ('PRIMARY'), ('EXCL_REVIEW_HIGH')) v(variant) LEFT JOIN l ON l.variant = v.variant AND l.seq = r.seq"""
)
def locked_weight_chain(spark, sf_dir):
    return index.locked_weight_chain(items(spark, sf_dir), event_basket(spark, sf_dir)).drop("collection_round_id")
