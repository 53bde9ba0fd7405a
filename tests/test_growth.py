"""Work that must not grow faster than the input, and rows that only larger tables have."""

import re

import duckdb
from pyspark.sql import functions as F

from faremill.functions import scalars as S
from faremill.operators import anomaly, consolidation, dashboard, routes, validation
from faremill.plans import registry, roles
from faremill.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_source_flag_totals_with_fares_of_nothing(spark, tmp_path):
    """only fares turned around are R01's, a fare of nothing is none of them."""
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("value", F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value")))
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["source_flag_totals"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = duck.execute(f"select {', '.join(got.columns)} from ({registry.ORACLES['source_flag_totals']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def _events(spark, tmp_path):
    """Events with fares of nothing, fares turned around, fares far off and ids that come twice."""
    n, v = F.col("event_id"), F.col("value")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("value", F.when(n % 10 == 0, 0.0).when(n % 29 == 0, -v).when(n % 31 == 0, v * 1000).otherwise(v))
    e.unionByName(e.where(n % 58 == 0)).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    return duck


def test_source_flags_are_of_all_rules(spark, tmp_path):
    """F1 of round 4: rules on observations and peers count as well as those on flights."""
    duck = _events(spark, tmp_path)
    got = registry.QUERIES["source_flags"](spark, str(tmp_path))
    rows = got.collect()
    assert all(r.flags > 0 and r.high_severity_observations > 0 and r.r13_cells > 0 for r in rows)
    want = duck.execute(f"select {', '.join(got.columns)} from ({registry.ORACLES['source_flags']})").fetchall()
    assert len(rows) == 4 and sorted(tuple(r) for r in rows) == sorted(want)


def test_source_flags_of_a_report(spark):
    """The report is read once, an observation's severity is its highest, and sources
    without a flag stay."""
    rows = spark.createDataFrame([("1", "A", "f1", "c1"), ("2", "A", "f2", "c1"), ("2", "A", "f2", "c1"), ("3", "B", "f1", "c1"), ("4", "C", None, None), (None, "B", "f3", "c2")], "observation_id string, source string, flight_cell_id string, consolidation_cell_id string")
    found = [("R01", "OBSERVATION", "1", "FLAGGED", "HIGH"), ("R03", "OBSERVATION", "1", "FLAGGED", "HIGH"), ("R02", "OBSERVATION", "2", "FLAGGED", "REVIEW"), ("R01", "OBSERVATION", "3", "NOT_EVALUABLE", "NONE")]
    found += [("R07", "FLIGHT_CELL", "f1", "FLAGGED", "INFO"), ("R08", "FLIGHT_CELL", "f2", "FLAGGED", "REVIEW"), ("R07", "FLIGHT_CELL", "f3", "NOT_EVALUABLE", "NONE"), ("R13", "CELL", "c1", "FLAGGED", "HIGH"), ("R09", "CELL", "c2", "FLAGGED", "INFO")]
    report = spark.createDataFrame(found, "rule_id string, entity_level string, entity_id string, status string, severity string")
    out = anomaly.source_flags(rows, report)
    assert {tuple(r) for r in out.select("source", "flags", "high_severity_observations", "r07_flight_cells", "r13_cells").collect()} == {("A", 4, 1, 1, 1), ("B", 0, 0, 1, 1), ("C", 0, 0, 0, 0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FLAGGED") == 1


def test_r08_names_the_source(spark):
    """The source furthest off the median, the first by name of several as far."""
    data = [("f1", 3, {"MMT": 100, "Goibibo": 160, "Cleartrip": 90}), ("f2", 3, {"MMT": 140, "Goibibo": 100, "Cleartrip": 60}), ("f3", 3, {"MMT": 100, "Goibibo": 101, "Cleartrip": 99}), ("f4", 2, {"MMT": 100, "Goibibo": 900})]
    f = spark.createDataFrame([(k, "c", n, min(m.values()), max(m.values()), m) for k, n, m in data], "flight_cell_id string, consolidation_cell_id string, priced_sources long, min_cents long, max_cents long, source_fares map<string,long>")
    c = spark.createDataFrame([("c", 1, 1)], "consolidation_cell_id string, participating_sources long, priced_flights long")
    got = {r.entity_id: (r.status, r.reason, r.value) for r in anomaly.flight_rules(f, c).where("rule_id = 'R08'").collect()}
    assert got == {"f1": ("FLAGGED", "Goibibo", 0.6), "f2": ("FLAGGED", "Cleartrip", 0.4), "f4": ("NOT_EVALUABLE", "INSUFFICIENT_SOURCE_COUNT_FOR_ATTRIBUTION", None)}


class Handle:
    """A state of one query in memory that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("getValueState", "getMapState"):
                return self
            if name == "get":
                return self.value
            if name in ("update", "clear"):
                self.value = args[0] if args else None
            elif name == "containsKey":
                return args[0] in self.map
            elif name == "updateValue":
                self.map[args[0]] = args[1]
            elif name == "removeKey":
                del self.map[args[0]]
            elif name == "keys":
                return iter(list(self.map))
            elif name == "registerTimer":
                self.timers.append(args[0])
            return None

        return call


class Mark:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_expiries_cost_few_calls_of_the_state(tmp_path):
    """the calls don't follow the captures of a query."""
    minute, h = 60_000, Handle()
    p = ingest._Expiry(120 * minute)
    p.init(h)
    times = [k * 7 * minute for k in range(1000)] + [20_000 * minute]
    list(p.handleInputRows(("a",), iter({"at": at} for at in reversed(times)), Mark(0)))
    end = 10_000 * minute
    out = []
    while any(t < end for t in h.timers):
        t = min(h.timers)
        h.timers.remove(t)
        mark = Mark(t)
        mark.getCurrentWatermarkInMs = lambda: end
        out += list(p.handleExpiredTimer(("a",), mark, mark))
    assert [r.at for r in out] == [999 * 7 * minute]
    assert h.calls < 20


def test_packed_maps_parse_a_member_once(spark):
    """what is parsed stands once in the expression."""
    df = spark.createDataFrame([("b=x; ;c",), ("a=1;a= 2.5 ;b=-",), (None,), ("=3;z=1=2;b=7.505;a=4;b=+1e1",)], "t string")
    out = df.select(S.unpacked_map(F.col("t")).alias("m"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract") == 2
    assert [{k: str(v) for k, v in r.m.items()} for r in out.collect()] == [{}, {"a": "2.50"}, {}, {"": "3.00", "b": "10.00", "a": "4.00"}]


def test_cases_without_an_observation_are_spread(spark):
    """they have no key in common, so no task has them all."""
    log = spark.range(400, numPartitions=4).select(F.when(F.col("id") % 2 == 0, "N/A").alias("observation_id"), F.lit("SOLD_OUT").alias("category"))
    verdicts = spark.createDataFrame([("OBS1", "VALID", ["X"])], "observation_id string, validation_status string, validation_errors array<string>")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = validation.edge_case_audit(verdicts, log).withColumn("task", F.spark_partition_id()).groupBy("audit_result").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"))
        assert {r.audit_result: (r.n, r.tasks > 2) for r in out.collect()} == {"NOT_APPLICABLE": (200, True), "NOT_FOUND": (200, True)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_observations_are_mapped_in_one_join(spark):
    """and their columns are made by methods short enough for the JVM to compile."""
    m = consolidation.members(roles.quotes(spark, SF))
    plan = consolidation.observation_map(m)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    text = m._sc._jvm.PythonSQLUtils.explainString(m._jdf.queryExecution(), "codegen")
    assert all(int(n) <= 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_bundles_work_ids_out_once(spark):
    """no test for nulls, which a join on the ids brings, goes down to the scan, where
    it would work them out anew; all that is generated stays short enough to be compiled."""
    m = consolidation.members(roles.quotes(spark, SF))
    cells = consolidation.cells(m).select("consolidation_cell_id", "fare_cents")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = routes.with_bundles(cells, routes.observation_bundles(m))
        text = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000
    assert not any("CELL::" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line)


def test_rules_are_generated_code(spark):
    """no rule stands under a lambda, which would have it interpreted, and no method
    is too long for the JVM to compile."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = dashboard.validation_totals(validation.validate(roles.raw_observations(spark, SF)))
        text = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000
    rules = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "MISSING_FARE_CLASS" in line]
    assert rules and all("*(" in line and "lambda" not in line for line in rules)
