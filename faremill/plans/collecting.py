"""Queries over collection control and reference data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import collection
from ..sources import tables
from .indexing import TRAFFIC, event_basket
from .roles import registry, table

QUERIES, ORACLES, query = registry()


def _sources(spark, sf_dir):
    """Nations in the role of sources, with one fault or another by key and region."""
    n, k, r = table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_regionkey")
    return n.select(
        F.col("n_name").alias("source_id"),
        F.when(k % 7 == 3, "MANUAL").otherwise("AUTHORIZED_API").alias("collection_mode"),
        F.lit("APPROVED").alias("authorization_status"),
        F.when(k % 5 == 4, "").otherwise("API_CONTRACT").alias("authorization_evidence_type"),
        F.lit("True").alias("allowed_automation"),
        F.when(k % 2 == 0, "ENABLED").otherwise("DISABLED").alias("adapter_status"),
        F.lit("APPROVED").alias("terms_review_status"),
        F.when(k == 6, "").when(k == 8, "2026-07-31").when(k == 10, "2026-09-02").otherwise("2026-08-02").alias("terms_review_date"),
        F.when(r == 1, "2026-08-31").when(r == 2, "2026-09-01").alias("authorization_expiry"),
        F.lit("ab12").alias("terms_content_hash"),
        F.when(k % 11 == 0, "UNKNOWN").when(k % 3 == 0, "NOT_APPLICABLE").otherwise("NO").alias("captcha_present"),
        F.lit("NO").alias("bot_protection_present"),
        F.when(k == 12, "UNKNOWN").otherwise("5s").alias("rate_limit_policy"),
        F.when(k != 14, "10").alias("maximum_requests_per_round"),
        F.lit("PASSED").alias("source_health_check"),
        F.when(k == 16, "FAILED").otherwise("PASSED").alias("dry_run_schedule_feasibility"),
    )


GATED = """gated AS (
  SELECT n_name, n_nationkey AS k, list_filter([CASE WHEN n_nationkey % 7 = 3 THEN 'COLLECTION_MODE' END, CASE WHEN n_nationkey % 5 = 4 THEN 'AUTHORIZATION_EVIDENCE' END, CASE WHEN n_nationkey % 2 = 1 THEN 'ADAPTER_DISABLED' END,
    CASE WHEN n_nationkey = 6 THEN 'TERMS_DATE_MISSING' END, CASE WHEN n_nationkey IN (8, 10) THEN 'TERMS_REVIEW_INACTIVE' END, CASE WHEN n_regionkey = 1 THEN 'AUTHORIZATION_EXPIRED' END, CASE WHEN n_nationkey % 11 = 0 THEN 'CAPTCHA' END,
    CASE WHEN n_nationkey = 12 THEN 'RATE_LIMIT_UNKNOWN' END, CASE WHEN n_nationkey = 14 THEN 'MAXIMUM_REQUESTS_MISSING' END, CASE WHEN n_nationkey = 16 THEN 'DRY_RUN_FEASIBILITY' END], lambda x: x IS NOT NULL) AS faults FROM nation
)"""


MATRIX = f"""{TRAFFIC}, m AS (
  SELECT n_name AS source_id, n_nationkey, n_regionkey, route_id, CASE d WHEN 0 THEN split_part(route_id, '-', 1) ELSE split_part(route_id, '-', 2) END AS origin, CASE d WHEN 0 THEN split_part(route_id, '-', 2) ELSE split_part(route_id, '-', 1) END AS destination,
    w.wname AS "window", CAST('2026-09-01' AS DATE) + w.days AS travel_date, 'ROUND-2026-09-01 ' || anchor AS collection_round_id
  FROM basket, nation, (VALUES (0), (1)) x(d), (VALUES ('T1', 1), ('T7', 7), ('T15', 15), ('T30', 30), ('T45', 45)) w(wname, days), (VALUES ('09:00'), ('14:30'), ('20:15')) y(anchor)
)"""


@query(f"WITH {MATRIX} SELECT source_id, route_id, origin, destination, \"window\", CAST(travel_date AS VARCHAR) AS travel_date, collection_round_id FROM m")
def query_matrix(spark, sf_dir):
    m = collection.query_matrix(event_basket(spark, sf_dir), _sources(spark, sf_dir), "2026-09-01")
    return m.drop("query_id").withColumn("travel_date", F.col("travel_date").cast("string"))


@query(f"WITH {GATED} SELECT n_name AS source_id, len(faults) = 0 AS may_collect, array_to_string(faults, ';') AS gate_failures FROM gated")
def source_gate(spark, sf_dir):
    g = collection.gate(_sources(spark, sf_dir), "2026-09-01")
    return g.select("source_id", "may_collect", F.array_join("gate_failures", ";").alias("gate_failures"))


@query(f"WITH {MATRIX}, {GATED} SELECT route_id, count(*) AS planned, count(*) FILTER (len(faults) > 0) AS blocked, round(100.0 * count(*) FILTER (len(faults) = 0) / count(*), 4) AS coverage_pct FROM m JOIN gated ON m.source_id = gated.n_name GROUP BY route_id")
def collection_coverage(spark, sf_dir):
    s = _sources(spark, sf_dir)
    m = collection.query_matrix(event_basket(spark, sf_dir), s, "2026-09-01")
    return collection.collection_coverage(collection.dry_run(m, collection.gate(s, "2026-09-01")), "route_id")


@query("SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 48 HOUR")
def quote_ttl(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return collection.fresh(e, "2024-01-20 12:00:00", 48, "ts").select("event_id", "event_type")


@query("SELECT event_type AS run_id, count(*) AS attempts, count(*) FILTER (value >= 20 AND value <= 480) AS successes, CASE WHEN max(value) > 480 THEN 'DENIED' WHEN min(value) >= 20 THEN 'COMPLETE' ELSE 'PARTIAL' END AS run_status FROM events GROUP BY event_type")
def run_status(spark, sf_dir):
    outcome = F.when(F.col("value") > 480, "DENIED").when(F.col("value") >= 20, "SUCCESS").otherwise("FAILED")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), outcome.alias("outcome"), "value")
    return collection.run_status(e)


@query("WITH m AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem), s AS (SELECT unnest(generate_series(min(CAST(month || '-01' AS DATE)), max(CAST(month || '-01' AS DATE)), INTERVAL 1 MONTH)) AS d FROM m) SELECT strftime(d, '%Y-%m') AS month FROM s WHERE strftime(d, '%Y-%m') NOT IN (SELECT month FROM m)")
def month_gaps(spark, sf_dir):
    return tables.monthly_gaps(table(spark, sf_dir, "lineitem").select(S.month_id(F.col("l_shipdate")).alias("month")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_duplicates(spark, sf_dir):
    return tables.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
