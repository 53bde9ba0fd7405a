"""Baskets, routes, the chained index, anomaly rules, comparison and dashboards."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from faremill.operators import anomaly, backtest, basket, collection, consolidation, dashboard, index, routes
from faremill.sources import tables

CELL = "consolidation_cell_id string, origin string, destination string, travel_date string, fare_class string, advance_purchase_window string, collection_round_id string, round_alignment string, round_sort_key string, fare_cents long, observations long, sold_out_observations long, sources array<string>, participating_sources long, priced_flights long, price_state string, severity string"


def cells(spark, prices, sources=1, flights=1):
    """prices: {(origin, destination, class): [cents by round, None where absent, 0 where unpriced]}"""
    rows = []
    for (a, b, c), line in prices.items():
        for k, p in enumerate(line):
            if p is None:
                continue
            key = f"2026-09-{1 + k // 3:02d} " + ("09:00", "14:30", "20:15")[k % 3]
            rows.append((f"{a}{b}{c}{k}", a, b, "2026-10-01", c, "T30(25-35)", f"ROUND-{key}", "ANCHORED", key, p or None, 1, 0, ["MMT"], sources, flights, "PRICED" if p else "SOLD_OUT", "NONE"))
    return spark.createDataFrame(rows, CELL)


@pytest.fixture(scope="module")
def two(spark):
    b = basket.weighted(spark.createDataFrame([("AAA-BBB", 600), ("AAA-CCC", 300), ("DDD-EEE", 100)], "route_id string, passengers long"))
    prices = {("AAA", "BBB", "x"): [100, 110, 121, 0, 130], ("BBB", "AAA", "y"): [200, 200, None, 220, 220], ("CCC", "AAA", "x"): [50, 55, 50, 50, None], ("FFF", "GGG", "x"): [9, 9, 9, 9, 9]}
    return b, routes.route_cells(cells(spark, prices), b)


def test_weights_sum_to_one(spark):
    b = basket.weighted(spark.createDataFrame([(f"r{k}", n) for k, n in enumerate([7, 7, 3, 3, 3, 1, 1])], "route_id string, passengers long"))
    rows = b.orderBy("basket_rank").collect()
    assert sum(r.traffic_weight for r in rows) == Decimal(1) and [r.residual_micro == 0 for r in rows[1:]] == [True] * 6
    assert basket.checked(b) is b
    with pytest.raises(ValueError):
        basket.checked(b.where("basket_rank > 1"))


def test_greedy_basket(spark):
    rows = [(f"r{k:02d}", 100 - k, f"c{k}", f"c{k + 1}", "N", "S") for k in range(11)] + [("new", 50, "x", "y", "N", "E"), ("old", 49, "c1", "c2", "N", "S"), ("city", 48, "c1", "z", "N", "S")]
    r = basket.ranked(spark.createDataFrame(rows, "route_id string, passengers long, city_1 string, city_2 string, region_1 string, region_2 string"))
    got = {x.route_id: x.selection_stage for x in basket.diversified(r).collect()}
    assert [got.get(k) for k in ("r00", "r09", "new", "city", "r10", "old")] == ["TOP_TRAFFIC", "TOP_TRAFFIC", "NEW_REGION", "NEW_CITY", "NEW_CITY", None]


def test_greedy_basket_walks_few_routes(spark):
    """The same choice as a walk over the whole ranking."""
    import random

    rng = random.Random(3)
    rows = [(f"r{k:03d}", 1000 - k, f"c{rng.randrange(40)}", f"c{rng.randrange(40)}", f"g{min(rng.randrange(12), rng.randrange(12))}", f"g{min(rng.randrange(12), rng.randrange(12))}") for k in range(300)]
    r = basket.ranked(spark.createDataFrame(rows, "route_id string, passengers long, city_1 string, city_2 string, region_1 string, region_2 string"))
    for top, target in ((3, 15), (10, 60), (2, 4)):
        want, passed, regions, cities = {}, [], set(), set()
        for x in rows:
            stage = "TOP_TRAFFIC" if len(want) < top else "NEW_REGION" if len(want) < target and {x[4], x[5]} - regions else None
            if stage is None:
                passed.append(x)
                continue
            want[x[0]] = stage
            cities |= {x[2], x[3]}
            regions |= {x[4], x[5]}
        for x in passed:
            if len(want) < target and {x[2], x[3]} - cities:
                want[x[0]] = "NEW_CITY"
                cities |= {x[2], x[3]}
        assert {x.route_id: x.selection_stage for x in basket.diversified(r, top, target).collect()} == want


def test_fares_read_from_text(spark):
    rows = [("PRICED", "100"), ("PRICED", " "), ("PRICED", None), ("PRICED", "n/a"), ("PRICED", "0"), ("NOT_PRICED", "5"), ("NO_OBSERVATIONS", None)]
    g = spark.createDataFrame([("A-B", "x", "T1", "d", "NONE", *r) for r in rows], "route_id string, fare_class string, advance_purchase_window string, travel_date string, max_severity string, route_price_state string, median_cents string")
    got = [r.index_eligibility_status for r in index.eligible(g, ("PRIMARY",)).collect()]
    assert sorted(got) == sorted(["ELIGIBLE", "MISSING_FARE", "MISSING_FARE", "UNPARSABLE_FARE", "NON_POSITIVE_FARE", "NOT_PRICED", "NO_OBSERVATIONS"])


def test_planned_searches(spark):
    b = spark.createDataFrame([("AAA-BBB", 1), ("CCC-DDD", 2)], "route_id string, basket_rank int")
    assert collection.planned_searches(b, "2026-09-01").count() == 20
    one = collection.planned_searches(b, "2026-09-01", ("ddd-ccc",)).collect()
    assert len(one) == 10 and {r.route_id for r in one} == {"CCC-DDD"}
    with pytest.raises(ValueError, match="XXX"):
        collection.planned_searches(b, "2026-09-01", ("AAA-XXX",))


def test_itinerary_offers_of_odd_payloads(spark):
    good = '{"content":{"results":{"itineraries":{"i":{"legIds":["l"],"pricingOptions":[{"id":"o","agentIds":[],"price":{"amount":"12500","unit":"%s"}}]}},"legs":{"l":{"stopCount":"0"}}}}}'
    bodies = [good % "PRICE_UNIT_CENTI", good % "PRICE_UNIT_UNSPECIFIED", good.replace('"0"', '"many"') % "PRICE_UNIT_CENTI", "{}", "no json", None, good.replace('"l"]', '"lost"]') % "PRICE_UNIT_CENTI"]
    p = spark.createDataFrame([(str(k), "t", x) for k, x in enumerate(bodies)], "query_id string, collected_at string, payload string")
    rows = collection.itinerary_offers(p, {"Saver": "Economy Saver"}, ("Economy Saver",)).collect()
    assert [(r.query_id, r.total_fare, r.agent, r.carrier, r.departure_at, r.fare_class_action) for r in rows] == [("0", Decimal("125.00"), None, None, None, "UNKNOWN_FARE_CLASS")]


def test_full_measures_of_cells_without_observations(spark):
    c = cells(spark, {("AAA", "BBB", "x"): [100, 0]}).withColumns({"severity": F.lit("HIGH"), "flagged_rules": F.array(F.lit("R09")), "not_evaluable_rules": F.array().cast("array<string>")})
    b = routes.route_cells(c, spark.createDataFrame([("AAA-BBB",)], "route_id string"))
    none = "consolidation_cell_id string, mapped_observations long, contributing_ids array<string>, excluded_sold_out_ids array<string>, sold_out_in_bundle long, flight_cell_ids array<string>"
    r = routes.full_measures(routes.with_bundles(b, spark.createDataFrame([], none)), ("route_id",)).first()
    assert (r.contributing_cells, r.priced_cells, r.unpriced_cells, r.median_cents, r.relative_spread) == (2, 1, 1, 100, 0)
    assert (r.high_severity_cells, r.max_severity, r.anomaly_rule_ids, r.not_evaluable_rule_ids, r.recommended_review) == (2, "HIGH", "R09", "", True)
    assert (r.contributing_observations, r.contributing_observation_ids, r.flight_cells, r.mapped_observations) == (0, "", 0, 0)


def test_zero_rows_and_directions(two):
    b, routed = two
    a = {(r.route_id, r.fare_class, r.collection_round_id): r for r in routes.grain_a(routed, b).collect()}
    idle = a["DDD-EEE", None, None]
    assert (idle.cells, idle.median_cents, idle.coverage_status) == (0, None, "NO_OBSERVATIONS") and len(a) == 13 + 1
    c = {r.route_id: (r.coverage_status, r.cells) for r in routes.coverage(routed, b).collect()}
    assert c == {"AAA-BBB": ("OBSERVED_VIA_CANONICAL_KEY", 9), "AAA-CCC": ("OBSERVED_VIA_CANONICAL_KEY", 4), "DDD-EEE": ("NO_OBSERVATIONS", 0)}
    assert routes.off_basket(routed).count() == 5
    walk = {(r.route_id, r.directed_pair): r.direction_relation for r in routes.crosswalk(routed, b).collect()}
    assert walk["AAA-BBB", "BBB-AAA"] == "CANONICALIZED_FROM_REVERSE" and walk["FFF-GGG", "FFF-GGG"] == "OFF_BASKET" and walk["DDD-EEE", None] == "NO_OBSERVATIONS"


def test_chain_by_hand(two):
    b, routed = two
    it = index.eligible(routes.grain_a(routed, b))
    rows = {r.link_sequence: r for r in index.round_index(it, b).where("variant = 'PRIMARY'").collect()}
    w = {"B": 0.6, "C": 0.3}
    l1 = (w["B"] * (math.log(1.1) + 0) / 2 + w["C"] * math.log(1.1)) / 0.9
    l2 = (w["B"] * math.log(1.1) + w["C"] * math.log(50 / 55)) / 0.9
    l3 = 0.0
    l4 = 0.0
    level = 100.0
    for k, x in enumerate((0, l1, l2, l3, l4)):
        level *= math.exp(x)
        assert abs(rows[k].index_level - level) < 1e-6
    assert [rows[k].matched_items for k in range(5)] == [0, 3, 2, 1, 1]
    # An item that skipped a round enters again; it is not matched with two rounds ago.
    assert (rows[3].entering_items, rows[2].leaving_items) == (1, 1)
    assert rows[0].routes_represented == 2 and rows[0].coverage_status == "PARTIAL_COVERAGE_PROTOTYPE"


def test_empty_link_holds_the_level(spark):
    b = basket.weighted(spark.createDataFrame([("AAA-BBB", 1)], "route_id string, passengers long"))
    routed = routes.route_cells(cells(spark, {("AAA", "BBB", "x"): [100, 120, 0, 150], ("AAA", "BBB", "y"): [None, None, 70, None]}), b)
    rows = index.round_index(index.eligible(routes.grain_a(routed, b)), b).where("variant = 'PRIMARY'").orderBy("link_sequence").collect()
    assert [r.index_level for r in rows] == [100, 120, 120, 120] and [r.chain_factor for r in rows] == [None, 1.2, None, None]


def test_lineage_weights_and_periods(two):
    b, routed = two
    it = index.eligible(routes.grain_a(routed, b))
    sums = index.index_lineage(it, b).groupBy("variant", "link_sequence").agg(F.sum("contribution_weight").alias("s")).collect()
    assert sums and all(abs(r.s - 1) < 1e-12 for r in sums)
    rounds = index.round_index(it, b)
    p = {(r.period_grain, r.period_id): r for r in index.period_index(rounds).where("variant = 'PRIMARY'").collect()}
    assert p["DAILY", "2026-09-01"].period_is_partial is False and p["DAILY", "2026-09-02"].rounds == 2 and p["MONTHLY", "2026-09"].expected_rounds == 90
    base = rounds.where("link_sequence = 2").first().collection_round_id
    again = index.rebased(rounds, base).where("variant = 'PRIMARY'").collect()
    level = {r.link_sequence: r.index_level for r in again}
    assert all(abs(r.rebased_level - 100 * r.index_level / level[2]) < 1e-6 for r in again)
    assert index.index_coverage(it, b).count() == 5 * 3 * 2


def test_severity_excludes_in_one_variant(spark):
    b = basket.weighted(spark.createDataFrame([("AAA-BBB", 1)], "route_id string, passengers long"))
    c = cells(spark, {("AAA", "BBB", "x"): [100, 200], ("AAA", "BBB", "y"): [100, 110]}).withColumn("severity", F.when(F.col("fare_cents") == 200, "HIGH").otherwise("NONE"))
    rows = {r.variant: r for r in index.round_index(index.eligible(routes.grain_a(routes.route_cells(c, b), b)), b).where("link_sequence = 1").collect()}
    assert rows["PRIMARY"].matched_items == 2 and rows["EXCL_REVIEW_HIGH"].matched_items == 1 and rows["EXCL_REVIEW_HIGH"].index_level == 110


# --- anomaly rules ------------------------------------------------------------------
def flagged(rows, rule):
    return {r.entity_id: (r.severity, r.value) for r in rows.where(f"rule_id = '{rule}' and status = 'FLAGGED'").collect()}


def test_lag_and_drift(spark):
    c = cells(spark, {("A", "B", "x"): [100, 100, 100, 115, 116, 140, 200], ("A", "B", "y"): [100, 100, 100, 131, 131, 131, 131]})
    r = anomaly.series_rules(c)
    r05 = flagged(r, "R05")
    assert set(r05) == {"ABx5", "ABx6", "ABy3"} and r05["ABx5"][0] == "REVIEW" and r05["ABx6"][0] == "HIGH" and r05["ABy3"] == ("HIGH", 0.31)
    assert flagged(r, "R06") == {"ABx5": ("HIGH", 0.4), "ABx6": ("HIGH", 0.73913)}
    calm = anomaly.series_rules(cells(spark, {("A", "B", "y"): [100, 100, 100, 131]}, sources=2, flights=2))
    assert flagged(calm, "R05")["ABy3"][0] == "REVIEW"


def test_peers(spark):
    prices = {("A", "B", "x"): [100, 101, 99, 100, 102, 98, 400]}
    r = flagged(anomaly.peer_rules(cells(spark, prices)), "R13")
    assert set(r) == {"ABx6"} and r["ABx6"][0] == "REVIEW"  # peers of all rounds: REVIEW at most
    same = anomaly.peer_rules(cells(spark, {("A", "B", "x"): [100] * 6}))
    assert {x.reason for x in same.collect()} == {"ZERO_PEER_DISPERSION"}
    few = anomaly.peer_rules(cells(spark, {("A", "B", "x"): [100, 120]}))
    assert {x.reason for x in few.collect()} == {"INSUFFICIENT_PEER_COUNT"}


def test_information_rules_and_roll_up(spark):
    c = cells(spark, {("A", "B", "x"): [100, 0]})
    rows = anomaly.cell_rules(c).unionByName(anomaly.history_rules(c))
    assert set(flagged(rows, "R11")) == {"ABx1"} and len(flagged(rows, "R09")) == 2 and len(flagged(rows, "R10")) == 1
    out = {r.consolidation_cell_id: (r.flagged_rules, r.severity) for r in anomaly.annotated_cells(c.drop("severity"), rows).collect()}
    assert out == {"ABx0": ("R09", "INFO"), "ABx1": ("R09;R11", "INFO")}


def test_a_fare_of_zero_is_no_base(spark):
    """Free quotes: consolidated like any other, and no ratio over them."""
    row = lambda k, fare, source, flight="F1": (str(k), "AAA", "BBB", "C", flight, "2026-10-01", "08:10", f"2026-09-0{1 + k // 9} 09:0{k % 9}", "T30(25-35)", "x", "0", "0", "0", fare, source, "Available")
    names = "observation_id origin destination carrier flight_number travel_date departure_time collection_timestamp advance_purchase_window fare_class base_fare taxes fees total_fare source availability_status".split()
    data = [row(0, "0.00", "MMT"), row(1, "0.00", "Goibibo"), row(2, "0.00", "Cleartrip"), row(3, "0.00", "MMT", "F2"), row(9, "10.00", "MMT")]
    m = consolidation.members(spark.createDataFrame(data, ", ".join(f"{n} string" for n in names)))
    f, c = consolidation.flight_cells(m), consolidation.cells(m)
    got = {r.fare_cents: r for r in c.collect()}
    assert got[0].cross_flight_relative_spread is None and got[0].observations == 4 and got[0].flights == 2 and got[1000].sources == ["MMT"] and got[0].sources == ["Cleartrip", "Goibibo", "MMT"]
    rows = {(r.rule_id, r.reason) for r in anomaly.flight_rules(f, c).where("status = 'NOT_EVALUABLE'").collect()}
    assert {("R07", "NO_PRICE_TO_EVALUATE"), ("R08", "NO_PRICE_TO_EVALUATE")} <= rows
    line = cells(spark, {("AAA", "BBB", "x"): [100, 100, 100, 100, 100]}).withColumn("fare_cents", F.when(F.col("round_sort_key") == "2026-09-01 20:15", 0).otherwise(F.col("fare_cents")))
    out = {(r.rule_id, r.entity_id): r.reason for r in anomaly.series_rules(line).where("status = 'NOT_EVALUABLE'").collect()}
    assert out["R05", "AAABBBx3"] == "NO_PRICE_TO_EVALUATE" and out["R06", "AAABBBx4"] == "NO_PRICE_TO_EVALUATE" and out["R05", "AAABBBx1"] == "INSUFFICIENT_PRIOR_ROUNDS"
    assert anomaly.history_rules(cells(spark, {("AAA", "BBB", "x"): [1, 2, 3], ("AAA", "BBB", "y"): [1, 2, 3, 4]})).count() == 1


# --- comparison -----------------------------------------------------------------------
def months(n, f):
    return [(f"{2024 + k // 12}-{k % 12 + 1:02d}", f(k)) for k in range(n)]


def test_metrics_need_their_samples(spark):
    a = spark.createDataFrame([(m, v, False) for m, v in months(20, lambda k: 100 + 5 * math.sin(k))], "month string, level double, period_is_partial boolean")
    b = spark.createDataFrame(months(20, lambda k: 50 + 2 * math.sin(k + 0.3)), "month string, reference_level double")
    full = {r.metric: r for r in backtest.metrics(backtest.pairs(backtest.month_comparison(a, b))).collect()}
    assert {r.status for r in full.values()} == {"COMPUTED"} and full["LEAD_0"].value == full["PEARSON"].value and 0.8 < full["PEARSON"].value < 1
    few = {r.metric: r.status for r in backtest.metrics(backtest.pairs(backtest.month_comparison(a.limit(7).orderBy("month"), b))).collect()}
    assert few["MAE"] == "COMPUTED" and few["PEARSON"] == "INSUFFICIENT_SAMPLE"
    assert len(full) == 17 and full["MAPE"].sample == 20 and full["PEARSON"].sample == 19
    level = [(100 * math.fsum([100 + 5 * math.sin(k)]) / 100, 100 * (50 + 2 * math.sin(k + 0.3)) / (50 + 2 * math.sin(0.3))) for k in range(20)]
    assert full["MAPE"].value == pytest.approx(100 * sum(abs(x - y) / y for x, y in level) / 20, abs=1e-6)
    top = [max(range(20), key=lambda k: s[k]) for s in zip(*level)]
    assert full["PEAK_TIMING"].value == top[0] - top[1] and 0 <= full["TURNING_AGREEMENT"].value <= 100
    with pytest.raises(Exception, match="positive reference"):
        backtest.metrics(backtest.pairs(backtest.month_comparison(a, b.withColumn("reference_level", F.when(F.col("month") == "2024-05", -1.0).otherwise(F.col("reference_level")))))).collect()
    partial = backtest.month_comparison(a.withColumn("period_is_partial", F.col("month") == "2025-08"), b)
    assert partial.where("match_status = 'EXCLUDED_PARTIAL_MONTH'").count() == 1


def test_calendar_gaps_break_changes(spark):
    s = spark.createDataFrame([("2024-01", 100.0), ("2024-02", 110.0), ("2024-04", 121.0), ("2025-01", 150.0)], "month string, value double")
    got = {r.month: (r.mom_pct, r.yoy_pct) for r in backtest.calendar_changes(s).collect()}
    assert got == {"2024-01": (None, None), "2024-02": (10.0, None), "2024-04": (None, None), "2025-01": (None, 50.0)}
    days = spark.sql("select explode(array(date'2026-01-01', date'2026-01-02', date'2026-01-05', date'2026-01-06', date'2026-01-07')) as day")
    assert tuple(backtest.longest_run_of_days(days).first()) == (3, 2)


# --- dashboards, collection, sources --------------------------------------------------------
def test_pages_and_filters(spark):
    df = spark.range(25).withColumn("round_sort_key", F.lpad(F.col("id").cast("string"), 2, "0"))
    rows, total, after = dashboard.page(dashboard.filtered(df, "03", "20"), ["id"], 10, 10)
    assert ([r.id for r in rows.collect()], total, after) == (list(range(13, 21)), 18, None)
    assert dashboard.page(df, ["id"], 10, 0)[2] == 10
    with pytest.raises(ValueError):
        dashboard.filtered(df, colour="red")
    with pytest.raises(ValueError):
        dashboard.page(df, ["id"], 5000)
    assert dashboard.export(df.limit(2), "csv")[0] == "id,round_sort_key"


def test_query_matrix_and_gate(spark):
    b = spark.createDataFrame([(f"AAA-{chr(66 + k) * 3}",) for k in range(15)], "route_id string")
    good = {"collection_mode": "AUTHORIZED_API", "authorization_status": "APPROVED", "authorization_evidence_type": "API_CONTRACT", "allowed_automation": "True", "adapter_status": "ENABLED", "terms_review_status": "APPROVED", "terms_review_date": "2026-08-02", "authorization_expiry": "", "terms_content_hash": "ab", "captcha_present": "NO", "bot_protection_present": "NOT_APPLICABLE", "rate_limit_policy": "5s", "maximum_requests_per_round": "10", "source_health_check": "PASSED", "dry_run_schedule_feasibility": "PASSED"}
    faults = {"s0": ("terms_review_status", "PENDING"), "s2": ("authorization_expiry", "2026-08-31"), "s3": ("terms_review_date", "2026-08-01"), "s4": ("captcha_present", ""), "s5": ("terms_review_date", None)}
    rows = [{**good, "source_id": f"s{k}", **dict([faults.get(f"s{k}", ("source_id", f"s{k}"))])} for k in range(11)]
    s = spark.createDataFrame([tuple(r[c] for c in ("source_id", *good)) for r in rows], ", ".join(f"{c} string" for c in ("source_id", *good)))
    m = collection.query_matrix(b, s, "2026-09-01")
    assert m.count() == 4950 == m.select("query_id").distinct().count()
    g = collection.gate(s, "2026-09-01")
    assert {r.source_id: r.gate_failures for r in g.where("not may_collect").collect()} == {"s0": ["TERMS_NOT_APPROVED"], "s2": ["AUTHORIZATION_EXPIRED"], "s3": ["TERMS_REVIEW_INACTIVE"], "s4": ["CAPTCHA"], "s5": ["TERMS_DATE_MISSING"]}
    assert collection.checked_registry(s, tuple(f"s{k}" for k in range(11))) is s
    with pytest.raises(ValueError):
        collection.checked_registry(s, ("s0",))
    names = (*collection.PARTNER_SETTINGS, "authorized", "authorization_expiry")
    fine = dict(zip(names, ("k", "ref", "2026-08-20", "1", "a" * 64, "24", "true", "true", "")))
    cases = [{}, {"api_key": " "}, {"authorized": "no"}, {"terms_sha256": "zz"}, {"terms_review_date": "2026-07-01"}, {"retention_hours": "0"}, {"authorization_expiry": "2026-08-31"}]
    p = spark.createDataFrame([tuple({**fine, **c}[n] for n in names) for c in cases], ", ".join(f"{n} string" for n in names))
    assert [r.block_reason for r in collection.partner_gate(p, "2026-09-01").collect()] == [None, "MISSING: api_key", "NOT_AUTHORIZED", "TERMS_HASH_INVALID", "TERMS_REVIEW_INACTIVE", "RETENTION_TOO_SHORT", "AUTHORIZATION_EXPIRED"]
    c = {r.source_id: r.blocked for r in collection.collection_coverage(collection.dry_run(m, g), "source_id").collect()}
    assert c["s0"] == 450 and c["s1"] == 0


def test_recorded_payloads(spark, tmp_path):
    from faremill.sources.recorded import RecordedQuotes

    leg = '{"flight_number": "6e 2341", "airline": "IndiGo", "departure_airport": {"id": "DEL", "time": "2026-09-08 08:10"}, "arrival_airport": {"id": "BOM"}, "travel_class": "Economy"}'
    payload = '{"best_flights": [{"price": 5000, "flights": [%s]}, {"price": 0, "flights": [%s]}], "other_flights": [{"price": 6000.5, "flights": [%s, %s]}, {"price": 5500, "flights": [%s]}]}' % ((leg,) * 5)
    (tmp_path / "a.jsonl").write_text('{"query_id": "q", "collected_at": "2026-09-01T09:00:00", "payload": %s}\n' % payload)
    spark.dataSource.register(RecordedQuotes)
    got = collection.flattened(spark.read.format("recorded_quotes").load(str(tmp_path))).collect()
    assert [(r.fare_cents, r.departure_time, r.flight_number) for r in got] == [(500_000, "08:10", "6E 2341"), (550_000, "08:10", "6E 2341")]
    q = spark.sql("select 1 as id, timestamp_ntz'2026-09-01 10:00:00' as collected_at union all select 2, timestamp_ntz'2026-09-01 09:59:59'")
    assert [r.id for r in collection.fresh(q, "2026-09-01 11:59:59").collect()] == [1]


def test_tables(spark, tmp_path):
    import hashlib
    import json

    (tmp_path / "t.csv").write_bytes("﻿a,b\n1,\n2,x\n".encode())
    df = tables.read_csv(spark, str(tmp_path / "t.csv"), ("a", "b"))
    assert [tuple(r) for r in df.collect()] == [("1", None), ("2", "x")]
    assert tables.read_csv(spark, str(tmp_path / "t.csv"), blank_is_null=False).first().b == ""
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "t.csv"), ("a", "c"))
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "out"), ("a",), forbidden=("b",))
    tables.write_table(df, str(tmp_path / "out"), ("b", "a"), order=("a",))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["b", "a"]
    raw = (tmp_path / "t.csv").read_bytes()
    manifest = {"tables": {"t": {"file": "t.csv", "sha256": hashlib.sha256(raw).hexdigest(), "columns": ["a", "b"], "schema_version": "1"}}}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert tables.load_snapshot(spark, str(tmp_path), str(tmp_path / "m.json"))["t"].count() == 2
    manifest["tables"]["t"]["sha256"] = "0"
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    with pytest.raises(ValueError):
        tables.load_snapshot(spark, str(tmp_path), str(tmp_path / "m.json"))
    gaps = tables.monthly_gaps(spark.createDataFrame([("2025-11",), ("2026-02",)], "month string"))
    assert sorted(r.month for r in gaps.collect()) == ["2025-12", "2026-01"]
    syn = tables.synthetic_observations(spark, 200)
    from faremill.operators import validation

    assert validation.validate(syn).where("not is_valid").count() == 0 and syn.exceptAll(tables.synthetic_observations(spark, 200)).count() == 0


def test_traffic_is_prepared(spark):
    from faremill.operators import traffic

    known = ("Northern Harbour International Airport",)
    rows = [("S.No", "CITY", "CITY", "x", "y"), (" ", "a", "b", "1", "2"), ("1", " new  town", "Northern Harbour International Airp", "ort 1,200", "-"), ("2", "Northern Harbour International Air", "port Old Town", "5", None), ("3", "A", "a ", "x1", "7"), ("4", "northern harbour international airport", "B", "1", "2")]
    got = traffic.prepared(spark.createDataFrame(rows, "first string, city_1 string, city_2 string, to_2 string, to_1 string"), ("S.No",), known)
    out = {r["first"]: (r.city_1, r.city_2, r.passengers_out, r.flag_back, r.repair_type, r.needs_review) for r in got.collect()}
    whole = known[0].upper()
    assert out == {"1": ("NEW TOWN", whole, 1200, "DGCA_DASH", "CITY2_PAX_BOUNDARY_BLEED", True), "2": (whole, "OLD TOWN", 5, "MISSING_EMPTY", "CITY1_CITY2_BOUNDARY_BLEED", True), "3": ("A", "A", None, "", "", True), "4": (whole, "B", 1, "", "", False)}
    p = traffic.profile(got).first()
    assert (p.total_rows, p.valid_rows, p.self_pairs, p.missing_out, p.most, p.total) == (4, 1, 1, 1, 1200, 1215)


def test_orders_and_whitelists(spark, two):
    b, routed = two
    rows = index.ordered(index.round_index(index.eligible(routes.grain_a(routed, b)), b)).select("variant", "link_sequence").collect()
    assert [r.variant for r in rows] == sorted((r.variant for r in rows), key=index.VARIANTS.index) and [r.link_sequence for r in rows[:5]] == [0, 1, 2, 3, 4]
    r = anomaly.cell_rules(cells(spark, {("B", "A", "x"): [1, 0], ("A", "B", "x"): [1]}))
    keys = [(x.rule_id, x.entity_level, x.entity_id, x.status) for x in anomaly.ordered(r).collect()]
    assert keys == sorted(keys) and len(keys) == 4
    assert dashboard.only(r, ("status", "rule_id")).columns == ["status", "rule_id"]
    with pytest.raises(ValueError):
        dashboard.only(r, ("colour",))


def test_grain_a_contract(spark):
    b = basket.weighted(spark.createDataFrame([("AAA-BBB", 600), ("CCC-DDD", 300)], "route_id string, passengers long"))
    good = routes.grain_a(routes.route_cells(cells(spark, {("AAA", "BBB", "x"): [100, 0, 120]}), b), b)
    assert index.checked(good, b).count() == 4
    first = good.where("collection_round_id = 'ROUND-2026-09-01 09:00'")
    faulty = {
        "outside": good.withColumn("route_id", F.lit("XXX-YYY")),
        "twice": good.unionByName(first),
        "two sort keys": good.unionByName(first.withColumn("fare_class", F.lit("y")).withColumn("round_sort_key", F.lit("2026-09-09 09:00"))),
        "positive": good.withColumn("median_cents", F.when(F.col("median_cents") == 100, 0).otherwise(F.col("median_cents")).cast("long")),
    }
    for name, df in faulty.items():
        with pytest.raises(ValueError, match=name):
            index.checked(df, b)
