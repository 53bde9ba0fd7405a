"""Validation, duplicates, consolidation and normalisation on mutated base rows."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from faremill.functions import scalars as S
from faremill.operators import consolidation, dedup, normalization, validation
from faremill.sources import tables

BASE = dict(
    observation_id="OBS1", capture_signature="c", economic_signature="e", origin="DEL", destination="BOM", carrier="6E", flight_number="6E-1", travel_date="2026-09-08", departure_time="08:10",
    collection_timestamp="2026-09-01 09:05", advance_purchase_days="7", advance_purchase_window="T7(5-9)", fare_class="Economy Saver", base_fare="4000.00", taxes="800.00", fees="200.00", total_fare="5000.00", source="MMT", availability_status="Available",
)
SCHEMA = ", ".join(f"{c} string" for c in tables.RAW_COLUMNS)


def frame(spark, *changes):
    rows = [{**BASE, "observation_id": f"OBS{k}", **c} for k, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[c] for c in tables.RAW_COLUMNS) for r in rows], SCHEMA)


RULES = [
    ({}, []),
    ({"observation_id": " "}, ["MISSING_OBSERVATION_ID"]),
    ({"origin": None}, ["MISSING_ROUTE"]),
    ({"origin": "bom"}, ["ORIGIN_EQUALS_DESTINATION"]),
    ({"carrier": ""}, ["MISSING_CARRIER"]),
    ({"flight_number": ""}, ["MISSING_FLIGHT_NUMBER"]),
    ({"travel_date": ""}, ["MISSING_TRAVEL_DATE"]),
    ({"travel_date": "2026-02-30"}, ["IMPOSSIBLE_DATE"]),
    ({"travel_date": "1999-01-01"}, ["IMPOSSIBLE_DATE"]),
    ({"travel_date": "2026-9-8"}, []),
    ({"collection_timestamp": None}, ["MISSING_COLLECTION_TIMESTAMP"]),
    ({"travel_date": "x", "collection_timestamp": "y"}, ["IMPOSSIBLE_DATE", "IMPOSSIBLE_DATE"]),
    ({"departure_time": "8:10"}, ["INVALID_DEPARTURE_TIME"]),
    ({"travel_date": "2026-08-01", "advance_purchase_days": "", "advance_purchase_window": ""}, ["TRAVEL_DATE_BEFORE_COLLECTION"]),
    ({"advance_purchase_days": "8"}, ["ADVANCE_PURCHASE_DAYS_MISMATCH"]),
    ({"advance_purchase_days": "soon"}, ["NON_NUMERIC_ADVANCE_PURCHASE_DAYS"]),
    ({"advance_purchase_window": "T15(12-18)"}, ["ADVANCE_PURCHASE_WINDOW_MISMATCH"]),
    ({"fare_class": None}, ["MISSING_FARE_CLASS"]),
    ({"availability_status": ""}, ["MISSING_AVAILABILITY_STATUS"]),
    ({"availability_status": "Maybe"}, ["INVALID_AVAILABILITY_STATUS"]),
    ({"base_fare": "x"}, ["NON_NUMERIC_BASE_FARE"]),
    ({"taxes": "-1"}, ["NEGATIVE_TAXES"]),
    ({"total_fare": "5,000"}, ["NON_NUMERIC_TOTAL_FARE"]),
    ({"total_fare": "0", "base_fare": "0", "taxes": "0", "fees": "0"}, ["INVALID_TOTAL_FARE"]),
    ({"total_fare": ""}, ["MISSING_TOTAL_FARE"]),
    ({"total_fare": "4998.99"}, ["TOTAL_FARE_LESS_THAN_COMPONENTS"]),
    ({"total_fare": "4999.00"}, []),
    ({"source": ""}, ["MISSING_SOURCE"]),
    ({"total_fare": "", "availability_status": "Sold Out"}, []),
]


def test_every_rule(spark):
    got = {r.observation_id: r.validation_errors for r in validation.validate(frame(spark, *[c for c, _ in RULES])).collect()}
    assert {k if k.strip() else "OBS1": v for k, v in got.items()} == {f"OBS{k}": v for k, (_, v) in enumerate(RULES)}


def test_verdicts_and_audit(spark):
    v = validation.validate(frame(spark, {}, {"base_fare": ""}, {"total_fare": "", "availability_status": "Sold Out"}, {"source": ""}))
    assert [r[0] for r in v.orderBy("observation_id").select("validation_status").collect()] == ["VALID", "VALID_WITH_MISSING_OPTIONAL_FIELDS", "NON_PRICE_AVAILABILITY", "INVALID"]
    log = spark.createDataFrame([("OBS0", "BASELINE"), ("OBS2", "SOLD_OUT"), ("OBS3", "MISSING_SOURCE"), ("OBS1", "DUPLICATE"), ("OBS9", "BASELINE"), ("N/A", "FARE_CLASS_AVAILABILITY_GAP")], "observation_id string, category string")
    assert {r.observation_id: r.audit_result for r in validation.edge_case_audit(v, log).collect()} == {"OBS0": "PASS", "OBS2": "PASS", "OBS3": "PASS", "OBS1": "FAIL", "OBS9": "NOT_FOUND", "N/A": "NOT_APPLICABLE"}


@pytest.mark.parametrize(
    "text, want",
    [("09:00", "ROUND-2026-09-01 09:00"), ("08:30", "ROUND-2026-09-01 09:00"), ("09:31", None), ("14:00", "ROUND-2026-09-01 14:30"), ("20:45", "ROUND-2026-09-01 20:15"), ("23:00", None)],
)
def test_rounds(spark, text, want):
    ts = F.lit(f"2026-09-01 {text}:00").cast("timestamp_ntz")
    r = spark.range(1).select(S.collection_round(ts, F.lit("O1")).alias("r")).first().r
    assert r.round_id == (want or f"ROUND-UNALIGNED::2026-09-01 {text}") and r.alignment == ("ANCHORED" if want else "UNALIGNED")
    r = spark.range(1).select(S.collection_round(F.lit(None).cast("timestamp_ntz"), F.lit("O1")).alias("r")).first().r
    assert r.round_id == "ROUND-UNRESOLVED::O1"


def sweep(minutes, tolerance=15):
    out, anchor = [], None
    for m in minutes:
        if anchor is None or m - anchor > tolerance:
            anchor = m
        out.append(anchor)
    return out


def test_sweep_does_not_chain(spark):
    minutes = [1, 16, 20, 35, 36, 60, 74, 76, 300]
    rows = [(f"{k:02d}", "b", m) for k, m in enumerate(minutes)] + [("99", None, 5)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id string, bucket string, m int").withColumn("ts", F.timestamp_seconds(F.col("m") * 60).cast("timestamp_ntz"))
    got = {r.id: r.canonical for r in dedup.anchored_sweep(df, ["bucket"], "ts", "id").collect()}
    assert got == {f"{k:02d}": f"{minutes.index(a):02d}" for k, a in enumerate(sweep(minutes))} | {"99": "99"}


def test_sweep_of_long_stretches(spark):
    """Stretches that never pause, over many batches, ties in time, and a null bucket."""
    rng = random.Random(7)
    lines = {b: sorted(rng.randrange(900) for _ in range(400)) for b in ("x", "y", None)}
    rows = [(f"{b}{k:04d}", b, m) for b, line in lines.items() for k, m in enumerate(line)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, bucket string, m int").withColumn("ts", F.timestamp_seconds(F.col("m") * 60).cast("timestamp_ntz"))
    out = dedup.anchored_sweep(df, ["bucket"], "ts", "id").collect()
    want = {}
    for b, line in lines.items():
        anchor = None
        for k, m in enumerate(line):
            if anchor is None or m - line[anchor] > 15:
                anchor = k
            want[f"{b}{k:04d}"] = f"{b}{anchor:04d}"
    assert {r.id: r.canonical for r in out} == want
    sizes = {a: list(want.values()).count(a) for a in set(want.values())}
    assert all(r.group_size == sizes[r.canonical] for r in out) and len(out) == 1200


@pytest.mark.parametrize("seed, gaps", [(1, (1,)), (2, (1, 2, 7)), (3, (1, 1, 1, 14, 15, 16, 17, 40)), (4, (15,)), (5, (8, 16))])
def test_sweep_across_blocks(spark, seed, gaps):
    """Lines of many blocks: paths enter blocks, end in them, and cross several."""
    rng = random.Random(seed)
    rows, want = [], {}
    for b in "pq":
        m, line = rng.randrange(-9000, 9000), []
        for _ in range(6000):
            m += rng.choice(gaps)
            line.append(m)
        for k, (m, a) in enumerate(zip(line, sweep(line))):
            rows.append((f"{b}{k:05d}", b, m))
            want[f"{b}{k:05d}"] = a
    at = {(i[0], m): i for i, _, m in rows}
    df = spark.createDataFrame(rows, "id string, bucket string, m int").withColumn("ts", F.timestamp_seconds(F.col("m") * 60).cast("timestamp_ntz")).repartition(3)
    got = dedup.anchored_sweep(df, ["bucket"], "ts", "id").collect()
    assert {r.id: r.canonical for r in got} == {i: at[i[0], a] for i, a in want.items()}


def test_sweep_spreads_a_hot_bucket(spark):
    """A bucket with a capture a minute for a hundred days is dealt out by its blocks."""
    df = spark.range(150_000).select(F.col("id").cast("string").alias("id"), F.lit("b").alias("bucket"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    out = dedup.anchored_sweep(df, ["bucket"], "ts", "id")
    assert out.agg(F.count_if(F.col("id") == F.col("canonical")), F.min("group_size"), F.max("group_size"), F.count(F.lit(1))).first() == (150_000 / 16, 16, 16, 150_000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "mapInArrow" not in plan and plan.count("windowspecdefinition(_bucket#") == plan.count("windowspecdefinition(_bucket#") > 0
    for line in plan.splitlines():
        assert "windowspecdefinition(_bucket" not in line or "_block" in line or "canonical" in line


def test_sweep_of_nothing_and_of_missing_times(spark):
    df = spark.createDataFrame([("a", "b", None), ("c", "b", None), ("d", "b", 60)], "id string, bucket string, m int").withColumn("ts", F.timestamp_seconds("m").cast("timestamp_ntz"))
    assert {r.id: r.canonical for r in dedup.anchored_sweep(df, ["bucket"], "ts", "id").collect()} == {"a": "a", "c": "c", "d": "d"}
    assert dedup.anchored_sweep(df.where("false"), ["bucket"], "ts", "id").count() == 0


def test_duplicate_reasons(spark):
    raw = frame(
        spark,
        {},
        {"collection_timestamp": "2026-09-01 09:20", "total_fare": "5000"},
        {"collection_timestamp": "2026-09-01 09:21"},
        {"source": "Goibibo"},
        {"departure_time": ""},
        {"total_fare": "", "availability_status": "Sold Out"},
        {"total_fare": "", "availability_status": "Sold Out", "collection_timestamp": "2026-09-01 09:06", "capture_signature": "d"},
        {"carrier": ""},
    )
    d = dedup.deduplicate(validation.validate(raw))
    got = {r.observation_id: (r.duplicate_reason, r.retained, r.duplicate_of, r.capture_signature_agreement) for r in d.collect()}
    assert got["OBS0"] == ("RETAINED_CANONICAL_OF_DUPLICATE_GROUP", True, None, True)
    assert got["OBS1"] == ("TECHNICAL_DUPLICATE", False, "OBS0", True)
    assert got["OBS2"][0] == got["OBS3"][0] == "RETAINED_UNIQUE"
    assert got["OBS4"][:2] == ("EXCLUDED_MISSING_IDENTITY", True)
    assert got["OBS6"] == ("SOLD_OUT_TECHNICAL_DUPLICATE", False, "OBS5", False)
    assert got["OBS7"][:2] == ("SKIPPED_INVALID_BY_PHASE2", False)
    report = {r.duplicate_group_id: (r.group_size, r.member_ids, r.max_delta_minutes) for r in dedup.duplicate_report(d).collect()}
    assert report == {"DUPGRP-OBS0": (2, "OBS0;OBS1", 15), "DUPGRP-OBS5": (2, "OBS5;OBS6", 1)}
    assert dedup.canonical_view(d).count() == 5


def test_three_stages(spark):
    """Four flights of one source against one of another: a fare a flight, not a source."""
    flights = [("1", "MMT", "4000"), ("2", "MMT", "5000"), ("3", "MMT", "6000"), ("4", "MMT", "7000"), ("1", "Goibibo", "4100.01"), ("1", "MMT", "4200")]
    raw = frame(spark, *[{"flight_number": f, "source": s, "total_fare": t} for f, s, t in flights], {"total_fare": "", "availability_status": "sold out"}, {"source": ""}, {"collection_timestamp": ""})
    m = consolidation.members(raw)
    c = consolidation.cells(m).collect()
    assert len(c) == 1
    c = c[0]
    # Flight 1: MMT 4100.00, Goibibo 4100.01 -> 4100.01 (half a cent up).
    assert (c.fare_cents, c.priced_flights, c.flights, c.participating_sources, c.source_coverage) == (550_000, 4, 5, 2, "PARTIAL")
    assert c.max_flight_source_spread_cents == 1 and c.cross_flight_spread_cents == 289_999 and c.missing_sources == ["AirlineSite", "Cleartrip"]
    assert consolidation.source_first(m).first().source_first_cents == (500_000 + 410_001 + 1) // 2
    assert {r.participation_status for r in m.collect()} == {"PARTICIPATED", "EXCLUDED_SOLD_OUT", "EXCLUDED_MISSING_SOURCE", "EXCLUDED_NO_ROUND"}


def test_order_of_rows_does_not_matter(spark):
    rows = [{"total_fare": t, "source": s} for t, s in (("10", "MMT"), ("11", "MMT"), ("30", "Goibibo"))]
    found = {consolidation.cells(consolidation.members(frame(spark, *p))).first().fare_cents for p in permutations(rows)}
    assert found == {2025}


def test_normalisation_logs_what_it_does(spark):
    raw = frame(spark, {}, {"fare_class": "  economy   SAVER ", "origin": "del", "total_fare": "5000"}, {"source": "Elsewhere", "fees": "", "taxes": "x"})
    n = normalization.normalized(raw)
    log = [tuple(r) for r in normalization.report(n, "OBSERVATION", "observation_id").orderBy("entity_id", "field", "action").select("entity_id", "field", "action").collect()]
    assert log == [
        ("OBS1", "fare_class", "CASE_NORMALIZED"), ("OBS1", "fare_class", "WHITESPACE_NORMALIZED"), ("OBS1", "origin", "CANONICALIZED"), ("OBS1", "total_fare", "MONEY_QUANTIZED"),
        ("OBS2", "fees", "MISSING_VALUE"), ("OBS2", "source", "UNKNOWN_VALUE"), ("OBS2", "taxes", "UNPARSABLE_VALUE"),
    ]
    r = {x.observation_id: x for x in n.collect()}
    assert (r["OBS1"].fare_class, r["OBS1"].origin, str(r["OBS1"].total_fare)) == ("Economy Saver", "DEL", "5000.00")
    assert r["OBS0"].fare_reconciles is True and r["OBS2"].fare_reconciles is None and r["OBS2"].fare_decomposition_state == "INCOMPLETE"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = F.lit
    assert one(S.departure_time(t("8:10:59.9"))) == "08:10" and one(S.departure_time(t("25:10"))) is None
    assert one(S.fare_text(t("5400.00"))) == one(S.fare_text(t("5400"))) == "5400" and one(S.fare_text(t("5400.50"))) == "5400.5"
    assert one(S.route_id(t("del"), t("BOM"))) == "BOM-DEL" and one(S.route_id(t("DEL"), t(" "))) is None and one(S.route_id(t("DEL"), t("DEL"))) is None
    assert [one(S.expected_window(t(d))) for d in (0, 3, 9, 12, 36, 50, -1)] == ["T1(0-2)", "OUT_OF_BAND", "T7(5-9)", "T15(12-18)", "OUT_OF_BAND", "T45(40-50)", "OUT_OF_BAND"]
    assert one(S.period_id(t("2027-01-01 09:00"), "WEEKLY")) == "2026-W53" and one(S.expected_rounds(t("2026-02-10"), "MONTHLY")) == 84
    assert str(one(S.ratio_half_up(t(0.0000005)))) == "0.000001" and float(one(S.ratio_half_even(t(0.0000005)))) == 0
    assert [one(S.severity(S.downgrade(S.rank(t(s))))) for s in S.SEVERITIES] == ["NONE", "INFO", "INFO", "REVIEW"]
    tried = lambda status, attempt, blocked=False, after=None: tuple(one(S.retry(t(status), t(attempt), t(blocked), t(after).cast("int"))))
    assert [tried(503, 1), tried(503, 2), tried(503, 3)] == [("RETRYABLE", 30), ("RETRYABLE", 120), ("PERMANENT_FAILURE", 0)]
    assert [tried(429, 1), tried(429, 1, after=7), tried(501, 1), tried(408, 1)] == [("PERMANENT_FAILURE", 0), ("RETRYABLE", 7), ("PERMANENT_FAILURE", 0), ("RETRYABLE", 30)]
    assert [tried(200, 1), tried(200, 1, True), tried(None, 1)] == [("SUCCESS", 0), ("COMPLIANCE_BLOCK", 0), ("PERMANENT_FAILURE", 0)]
    assert tuple(one(S.legacy_fees(t(None).cast("int"), [t(1), t(2)]))) == (3, "SUM_OF_DISCLOSED_COMPONENTS") and one(S.legacy_fees(t(None).cast("int"), [t(1), t(None).cast("int")])).fees is None
    assert tuple(one(S.fare_class_of(t(" Y "), {"Y": "Economy Flexi"}, ("Economy Flexi",)))) == ("Economy Flexi", "MAPPED", True) and one(S.fare_class_of(t("J"), {"Y": "x"}, ("x",))).action == "UNKNOWN_FARE_CLASS"
    assert one(S.over(t(5), t(0))) is None and one(S.relative_change(t(4), t(5))) == 0.25
    assert one(S.redacted(F.create_map(t("api_key"), t("x"), t("q"), t("y")))) == {"api_key": "[REDACTED]", "q": "y"}
    assert one(S.packed(F.array(t("b"), t("a"), t("b")))) == "a;b" and one(S.unpacked(t("a; b;"))) == ["a", "b"]
    assert one(S.month_number(t("march"))) == 3 and one(S.unit_price(t(12345), t("PRICE_UNIT_CENTI"))) == __import__("decimal").Decimal("123.45")
    with pytest.raises(Exception, match="not a boolean"):
        one(S.strict_boolean(t("false")))
    with pytest.raises(Exception, match="not a route"):
        one(S.checked_route_id(t("DELBOM")))


def test_price_states_of_cells_and_flights(spark):
    rows = [("CONSOLIDATED", 5, 0, 1), ("CONSOLIDATED", None, 1, 0), ("NO_PRICE_ALL_SOLD_OUT", None, 2, 0), ("NO_PRICE_NO_USABLE_FARE", None, 1, None), ("NO_PRICE_ALL_MISSING", None, 0, 0), ("CONSOLIDATED", None, 3, 1)]
    df = spark.createDataFrame(rows, "status string, fare long, sold long, priced long")
    got = df.select(S.cell_price_state(F.col("status"), F.col("fare")).alias("cell"), S.flight_price_state(F.col("fare"), F.col("sold"), F.col("priced")).alias("flight")).collect()
    assert [r.cell for r in got] == ["PRICED"] + ["NO_PRICE_CELL"] * 5
    assert [r.flight for r in got] == ["PRICED", "SOLD_OUT", "SOLD_OUT", "SOLD_OUT", "MISSING_PRICE", "MISSING_PRICE"]


def test_whole_numbers_maps_and_searches(spark):
    df = spark.createDataFrame([(" 12.9 ", "a=1.5; b=x;c;a=2"), ("-3.7", ""), ("1,000", None), (None, "n=-1.005")], "i string, m string")
    got = df.select(S.integer(F.col("i")).alias("i"), S.unpacked_map(F.col("m")).alias("m")).collect()
    assert [r.i for r in got] == [12, -3, None, None]
    assert [{k: str(v) for k, v in r.m.items()} for r in got] == [{"a": "2.00"}, {}, {}, {"n": "-1.01"}]
    searches = [(" del", "BOM", "2026-09-02", "2026-09-01"), ("DEL", "bom", "2026-09-02", None), ("D1L", "BOM", "2026-09-02", None), ("DEL", None, "2026-09-02", None), ("DEL", "del ", "2026-09-02", None), ("DEL", "BOM", "2026-08-31", "2026-09-01")]
    df = spark.createDataFrame(searches, "a string, b string, t string, c string")
    got = df.select(S.search_problem(F.col("a"), F.col("b"), F.to_date("t"), F.to_date("c")).alias("p")).collect()
    assert [r.p for r in got] == [None, None, "INVALID_ORIGIN", "INVALID_DESTINATION", "ORIGIN_EQUALS_DESTINATION", "TRAVEL_BEFORE_COLLECTION"]


def test_map_flags(spark):
    rows = frame(
        spark, {}, {"source": "mmt ", "carrier": "ZZ", "departure_time": "8:10"}, {"source": "", "fare_class": "Mystery", "origin": " "}, {"collection_timestamp": "soon", "travel_date": "2026-02-30"},
        {"collection_timestamp": "", "total_fare": "n/a"}, {"fees": "", "total_fare": "5000"}, {"taxes": "900"}, {"availability_status": "Sold Out", "total_fare": ""}, {"departure_time": "noon", "advance_purchase_window": "T9"},
    )
    mapped = consolidation.members(rows)
    got = {r.observation_id: r for r in normalization.normalized_map(mapped, rows.where("observation_id <> 'OBS0'")).collect()}
    flags = {k: r.normalization_flags for k, r in got.items()}
    assert flags == {
        "OBS0": "FARE_DECOMPOSITION_INCOMPLETE",
        "OBS1": "UNKNOWN_CARRIER",
        "OBS2": "MISSING_ORIGIN|MISSING_SOURCE|UNKNOWN_FARE_CLASS",
        "OBS3": "INVALID_TRAVEL_DATE_FORMAT|MISSING_ROUND_SORT_KEY|UNPARSEABLE_COLLECTION_TIMESTAMP",
        "OBS4": "FARE_DECOMPOSITION_INCOMPLETE|MISSING_COLLECTION_TIMESTAMP|MISSING_PRICE|MISSING_ROUND_SORT_KEY|UNPARSEABLE_MONETARY_VALUE",
        "OBS5": "FARE_DECOMPOSITION_INCOMPLETE",
        "OBS6": "FARE_COMPONENTS_MISMATCH",
        "OBS7": "FARE_DECOMPOSITION_INCOMPLETE",
        "OBS8": "UNKNOWN_ADVANCE_PURCHASE_WINDOW",
    }
    assert got["OBS1"].source_canonical == "MMT" and got["OBS1"].departure_time_canonical == "08:10" and got["OBS1"].carrier_canonical == "ZZ"
    assert got["OBS7"].price_state == "SOLD_OUT" and got["OBS4"].price_state == "MISSING_PRICE"
    assert (got["OBS6"].fare_decomposition_complete, got["OBS6"].fare_components_reconcile, got["OBS5"].fare_components_reconcile) == (True, False, None)
    assert normalization.normalized_map(mapped.limit(0), rows).count() == 0


def test_cells_and_flights_stay_one_row_each(spark):
    rows = consolidation.members(frame(spark, {}, {"source": "Goibibo", "availability_status": "Sold Out", "total_fare": ""}, {"fare_class": "Mystery", "total_fare": ""}, {"collection_timestamp": "2026-09-01 11:00"}))
    cells = {r.consolidation_cell_id: r for r in normalization.normalized_cells(consolidation.cells(rows)).collect()}
    assert sorted((r.price_state, r.round_sort_key, r.round_sort_key_source, r.normalization_flags) for r in cells.values()) == [
        ("NO_PRICE_CELL", "2026-09-01 09:00", "ANCHOR_TIMESTAMP", "MISSING_PRICE|UNKNOWN_FARE_CLASS"),
        ("PRICED", "2026-09-01 09:00", "ANCHOR_TIMESTAMP", ""),
        ("PRICED", "2026-09-01 11:00", "ROUND_ID", ""),
    ]
    flights = normalization.normalized_flight_cells(consolidation.flight_cells(rows)).collect()
    assert sorted((r.price_state, r.round_sort_key, r.departure_time_canonical) for r in flights) == [("MISSING_PRICE", "2026-09-01 09:00", "08:10"), ("PRICED", "2026-09-01 09:00", "08:10"), ("PRICED", "2026-09-01 11:00", "08:10")]
