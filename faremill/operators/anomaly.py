"""Anomaly rules with a severity lattice.  Rows are annotated, never dropped.

Report rows exist for FLAGGED and NOT_EVALUABLE only: (rule_id, entity_level,
entity_id, status, severity, reason, value).  Thresholds are exceeded strictly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .selection import quantiles

REVIEW, HIGH = 0.15, 0.30
Z_REVIEW, Z_HIGH = 3.5, 7.0
PEERS_ROUND, PEERS_LEAST, PRIOR_LAG, PRIOR_DRIFT, HISTORY = 5, 3, 3, 4, 3
SERIES = ("origin", "destination", "fare_class", "advance_purchase_window", "travel_date")
PEER = ("origin", "destination", "fare_class")
#: Fares are counted by ranges of 65,536 cents, then within one.
FARE_PASSES = (16, 0)


def _row(rule, level, entity, status, severity, reason=None, value=None):
    text = lambda x: F.lit(None).cast("string") if x is None else x
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(level).alias("entity_level"), entity.alias("entity_id"), status.alias("status"), severity.alias("severity"), text(reason).alias("reason"), (F.lit(None) if value is None else value).cast("double").alias("value"))


def _tall(df: DataFrame, *rows) -> DataFrame:
    # The outer form: the plain one filters first, which runs every rule twice over.
    return df.select(F.explode_outer(F.array(*rows)).alias("r")).where("r is not null").select("r.*")


def _verdict(rule, level, entity, evaluable, reason, flagged, rank, value, named=None):
    """FLAGGED, NOT_EVALUABLE, or nothing for a pass.  ``named`` is the reason of a flag."""
    return F.when(~evaluable, _row(rule, level, entity, F.lit("NOT_EVALUABLE"), F.lit("NONE"), reason)).when(F.coalesce(flagged, F.lit(False)), _row(rule, level, entity, F.lit("FLAGGED"), S.severity(rank), named, value))


def observation_rules(rows: DataFrame) -> DataFrame:
    """R01 non-positive fare, R02 not a number, R03 parts do not add up."""
    c, oid = F.col, F.col("observation_id").cast("string")
    raw = c("total_fare").cast("string")
    parts = [S.money(c(n).cast("string")) for n in ("base_fare", "taxes", "fees")]
    total = S.money(raw)
    there = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    gap = F.abs(total - (parts[0] + parts[1] + parts[2]))
    blank = S.is_missing(raw) | raw.isNull()
    three = F.lit(3)
    return _tall(
        rows,
        _verdict("R01", "OBSERVATION", oid, total.isNotNull(), F.lit("NO_PRICE_TO_EVALUATE"), total <= 0, three, total),
        _verdict("R02", "OBSERVATION", oid, ~blank, F.lit("NO_PRICE_TO_EVALUATE"), S.number(raw).isNull(), three, None),
        _verdict("R03", "OBSERVATION", oid, there & total.isNotNull(), F.when(~there, "FARE_DECOMPOSITION_INCOMPLETE").otherwise("NO_PRICE_TO_EVALUATE"), gap > S.COMPONENT_TOLERANCE, three, gap),
    )


def framework_row(spark) -> DataFrame:
    """R04 is declared and inactive: one row says so."""
    return spark.range(1).select(_row("R04", "OBSERVATION", F.lit("FRAMEWORK"), F.lit("NOT_EVALUABLE"), F.lit("NONE"), F.lit("NO_FROZEN_CALIBRATION_SNAPSHOT")).alias("r")).select("r.*")


def _context(df: DataFrame):
    return S.market_class(F.col("participating_sources"), F.col("priced_flights")) == "COHERENT"


def series_points(cells: DataFrame) -> DataFrame:
    """Anchored, priced points of each product series, numbered, with lags."""
    line = Window.partitionBy(*SERIES).orderBy("round_sort_key", "consolidation_cell_id")
    out = cells.where("round_alignment = 'ANCHORED' and fare_cents is not null").withColumn("prior", F.row_number().over(line) - 1)
    return out.withColumns({f"lag{k}": F.lag("fare_cents", k).over(line) for k in (1, 2, 3)})


def series_rules(cells: DataFrame) -> DataFrame:
    """R05 change from one round to the next, R06 drift over three."""
    p = series_points(cells)
    cid, x = F.col("consolidation_cell_id"), F.col("fare_cents")
    coherent = _context(p)
    sound = (F.col("lag1") != 0) & (F.col("lag2") != 0) & (F.col("lag3") != 0)
    step = F.abs(S.relative_change(F.col("lag1"), x))
    drift = F.abs(S.relative_change(F.col("lag3"), x))
    s1, s2, s3 = F.signum(x - F.col("lag1")), F.signum(F.col("lag1") - F.col("lag2")), F.signum(F.col("lag2") - F.col("lag3"))
    same = (s1 != 0) & (s1 == s2) & (s2 == s3)
    rank = lambda v: F.when(coherent, S.downgrade(S.ladder(v, REVIEW, HIGH))).otherwise(S.ladder(v, REVIEW, HIGH))
    short = lambda least: F.when(F.col("prior") < least, "INSUFFICIENT_PRIOR_ROUNDS").otherwise("NO_PRICE_TO_EVALUATE")
    return _tall(
        p,
        _verdict("R05", "SERIES_POINT", cid, (F.col("prior") >= PRIOR_LAG) & step.isNotNull(), short(PRIOR_LAG), step > REVIEW, rank(step), F.round(step, 6)),
        _verdict("R06", "SERIES_POINT", cid, (F.col("prior") >= PRIOR_DRIFT) & F.coalesce(sound, F.lit(False)), short(PRIOR_DRIFT), same & (drift > REVIEW), rank(drift), F.round(drift, 6)),
    )


def history_rules(cells: DataFrame) -> DataFrame:
    """R10: series with three anchored priced points or fewer."""
    n = F.count_if((F.col("round_alignment") == "ANCHORED") & F.col("fare_cents").isNotNull())
    s = cells.groupBy(*SERIES).agg(n.alias("points"))
    return _tall(s, F.when(F.col("points") <= HISTORY, _row("R10", "SERIES", S.key("SERIES::", *[F.col(k) for k in SERIES]), F.lit("FLAGGED"), F.lit("INFO"), None, F.col("points"))))


def flight_rules(flights: DataFrame, cells: DataFrame) -> DataFrame:
    """R07 dispersion of one flight's fares, R08 the source furthest off the median, which
    it names as the reason (of several as far the first by name)."""
    ctx = cells.select("consolidation_cell_id", "participating_sources", "priced_flights")
    f = flights.join(ctx, "consolidation_cell_id")
    fid, n = F.col("flight_cell_id"), F.coalesce("priced_sources", F.lit(0))
    # What several places of the rules read stands in a column of its own, worked out once.
    f = f.withColumns({"_spread": S.relative_spread(F.col("min_cents"), F.col("max_cents")), "_order": F.array_sort(F.transform(F.map_values("source_fares"), lambda v: v.cast("double")))})
    spread, order = F.col("_spread"), F.col("_order")
    coherent = _context(f)
    two = F.when(coherent, S.downgrade(F.lit(2))).otherwise(2)
    k = F.size(order)
    med = F.when(k % 2 == 1, F.element_at(order, F.greatest(F.lit(1), F.floor((k + 1) / 2).cast("int")))).otherwise((F.element_at(order, F.greatest(F.lit(1), F.floor(k / 2).cast("int"))) + F.element_at(order, F.least(k, F.floor(k / 2).cast("int") + 1))) / 2)
    f = f.withColumn("_med", F.when(k > 0, med))
    f = f.withColumn("_worst", F.array_min(F.transform(F.map_entries("source_fares"), lambda e: F.struct((-S.over(F.abs(e["value"] - F.col("_med")), F.col("_med"))).alias("off"), e["key"].alias("source")))))
    worst = -F.col("_worst.off")
    return _tall(
        f,
        _verdict("R07", "FLIGHT_CELL", fid, (n >= 2) & spread.isNotNull(), F.when(n == 1, "SINGLE_SOURCE_CELL").otherwise("NO_PRICE_TO_EVALUATE"), spread > REVIEW, two, F.round(spread, 6)),
        _verdict("R08", "FLIGHT_CELL", fid, (n >= 3) & worst.isNotNull(), F.when(n < 3, "INSUFFICIENT_SOURCE_COUNT_FOR_ATTRIBUTION").otherwise("NO_PRICE_TO_EVALUATE"), worst > REVIEW, two, F.round(worst, 6), F.col("_worst.source")),
    )


def cell_rules(cells: DataFrame) -> DataFrame:
    """R09 thin coverage, R11 no price, R12 outside the anchored rounds."""
    cid = F.col("consolidation_cell_id")
    info = lambda rule, when, reason=None: F.when(when, _row(rule, "CELL", cid, F.lit("FLAGGED"), F.lit("INFO"), reason))
    return _tall(cells, info("R09", F.col("participating_sources") <= 1), info("R11", F.col("price_state") != "PRICED", F.col("price_state")), info("R12", F.col("round_alignment") != "ANCHORED", F.col("round_alignment")))


def _spread(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Median, MAD and IQR of a population, each by its own aggregation."""
    base = df.where("fare_cents is not null")
    mid = base.groupBy(*keys).agg(F.median("fare_cents").alias(f"{tag}_med"), F.count(F.lit(1)).alias(f"{tag}_n"), (F.percentile("fare_cents", F.lit(0.75)) - F.percentile("fare_cents", F.lit(0.25))).alias(f"{tag}_iqr"))
    # A group's first figures go through the second grouping, so no join brings them back.
    own = [F.max(f"{tag}_{n}").alias(f"{tag}_{n}") for n in ("med", "n", "iqr")]
    return base.join(mid, keys).groupBy(*keys).agg(*own, F.median(F.abs(F.col("fare_cents") - F.col(f"{tag}_med"))).alias(f"{tag}_mad"))


def _wide_spread(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """The same of populations of any size, by counting: peers of all rounds."""
    base = df.where("fare_cents is not null")
    mid = quantiles(base, keys, "fare_cents", {"_med": 0.5, "_q1": 0.25, "_q3": 0.75}, FARE_PASSES)
    # A median lies on whole or half cents, so deviations are counted in half cents, and
    # quartiles lie on quarters; as whole numbers they are keys of the second counting.
    whole = mid.select(*keys, F.col("n").alias("_n"), (2 * F.col("_med")).cast("long").alias("_med2"), (4 * (F.col("_q3") - F.col("_q1"))).cast("long").alias("_iqr4"))
    apart = base.join(whole, keys).withColumn("_apart", F.abs(2 * F.col("fare_cents") - F.col("_med2")))
    out = quantiles(apart, [*keys, "_n", "_med2", "_iqr4"], "_apart", {"_mad": 0.5}, FARE_PASSES)
    return out.select(*keys, F.col("_n").alias(f"{tag}_n"), (F.col("_med2") / 2).alias(f"{tag}_med"), (F.col("_iqr4") / 4).alias(f"{tag}_iqr"), (F.col("_mad") / 2).alias(f"{tag}_mad"))


def peer_scores(cells: DataFrame) -> DataFrame:
    """Robust z of each priced cell among its peers of the round; where these are fewer
    than five, among its peers of all rounds.  Without spread (MAD, then IQR) no z."""
    near = [*PEER, "collection_round_id"]
    out = cells.where("fare_cents is not null").join(_spread(cells, near, "r"), near).join(_wide_spread(cells, list(PEER), "p"), list(PEER))
    own = F.col("r_n") >= PEERS_ROUND
    pick = lambda n: F.when(own, F.col(f"r_{n}")).otherwise(F.col(f"p_{n}"))
    out = out.withColumns({"basis": F.when(own, "ROUND").otherwise("WIDENED"), "peers": pick("n"), "peer_median": pick("med"), "peer_mad": pick("mad"), "peer_iqr": pick("iqr")})
    gap = F.col("fare_cents") - F.col("peer_median")
    z = F.when(F.col("peers") < PEERS_LEAST, F.lit(None)).when(F.col("peer_mad") > 0, 0.6745 * gap / F.col("peer_mad")).when(F.col("peer_iqr") > 0, gap / (F.col("peer_iqr") / 1.349))
    return out.withColumn("modified_z", z)


def peer_rules(cells: DataFrame) -> DataFrame:
    """R13: ladder, then the cap of the widened basis, then the market, then REVIEW or
    HIGH as it comes out."""
    p = peer_scores(cells)
    z = F.abs("modified_z")
    rank = S.ladder(z, Z_REVIEW, Z_HIGH)
    rank = F.when(F.col("basis") == "WIDENED", F.least(rank, F.lit(2))).otherwise(rank)
    rank = F.when(_context(p), S.downgrade(rank)).otherwise(rank)
    reason = F.when(F.col("peers") < PEERS_LEAST, "INSUFFICIENT_PEER_COUNT").otherwise("ZERO_PEER_DISPERSION")
    rows = _tall(p, _verdict("R13", "CELL", F.col("consolidation_cell_id"), z.isNotNull(), reason, z > Z_REVIEW, rank, F.round("modified_z", 6)))
    bare = _tall(cells.where("fare_cents is null"), _row("R13", "CELL", F.col("consolidation_cell_id"), F.lit("NOT_EVALUABLE"), F.lit("NONE"), F.lit("NO_PRICE_TO_EVALUATE")))
    return rows.unionByName(bare)


def report(rows: DataFrame, flights: DataFrame, cells: DataFrame) -> DataFrame:
    """All rules' rows in one tall table."""
    parts = [observation_rules(rows), framework_row(rows.sparkSession), series_rules(cells), history_rules(cells), flight_rules(flights, cells), cell_rules(cells), peer_rules(cells)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def roll_up(rows: DataFrame) -> DataFrame:
    """Per entity: sorted rule ids flagged, and the highest severity."""
    return rows.groupBy("entity_level", "entity_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "FLAGGED", F.col("rule_id")))), ";").alias("flagged_rules"), S.severity(F.max(S.rank(F.col("severity")))).alias("max_severity"))


def annotated_cells(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Every cell with the rules flagged for it and its severity."""
    own = roll_up(rows.where("entity_level in ('CELL', 'SERIES_POINT')").withColumn("entity_level", F.lit("CELL"))).drop("entity_level")
    return cells.join(own.withColumnRenamed("entity_id", "consolidation_cell_id"), "consolidation_cell_id", "left").withColumn("severity", F.coalesce("max_severity", F.lit("NONE"))).drop("max_severity")


def inherited(rows: DataFrame, report_rows: DataFrame) -> DataFrame:
    """Every observation with the highest severity of itself, its flight and its cell."""
    top = report_rows.groupBy("entity_id").agg(F.max(S.rank(F.col("severity"))).alias("r"))
    out = rows
    for k, name in (("observation_id", "_o"), ("flight_cell_id", "_f"), ("consolidation_cell_id", "_c")):
        out = out.join(top.select(F.col("entity_id").alias(k), F.col("r").alias(name)), k, "left")
    best = F.greatest(*[F.coalesce(n, F.lit(0)) for n in ("_o", "_f", "_c")])
    return out.withColumn("inherited_severity", S.severity(best)).drop("_o", "_f", "_c")


def series_diagnostics(cells: DataFrame) -> DataFrame:
    p = series_points(cells)
    return p.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("round_sort_key").alias("first_round"),
        F.max("round_sort_key").alias("last_round"),
        F.min("fare_cents").alias("min_cents"),
        F.max("fare_cents").alias("max_cents"),
        F.median("fare_cents").alias("median_cents"),
        F.round(F.max(F.abs(S.relative_change(F.col("lag1"), F.col("fare_cents")))), 6).alias("max_abs_change"),
    )


def source_reliability(rows: DataFrame, flights: DataFrame) -> DataFrame:
    """Per source: counts by state, cells, and deviation from the flight median."""
    f = flights.select("flight_cell_id", "flight_cents")
    j = rows.join(f, "flight_cell_id", "left")
    gap = S.over(F.abs(F.col("fare_cents") - F.col("flight_cents")), F.col("flight_cents"))
    priced = F.col("priced")
    return j.groupBy("source").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(priced).alias("priced_observations"),
        F.count_if(F.col("participation_status") == "EXCLUDED_SOLD_OUT").alias("sold_out_observations"),
        F.count_if(F.col("participation_status") == "EXCLUDED_MISSING_PRICE").alias("missing_price_observations"),
        F.count_distinct("consolidation_cell_id").alias("cells"),
        F.round(F.median(F.when(priced, gap)), 6).alias("median_deviation"),
        F.round(F.max(F.when(priced, gap)), 6).alias("max_deviation"),
    )


def ordered(report_rows: DataFrame) -> DataFrame:
    return report_rows.orderBy("rule_id", "entity_level", "entity_id", "status")


def histograms(report_rows: DataFrame) -> DataFrame:
    """(dimension, value, n): report rows by severity, status and rule, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in (("severity", "severity"), ("evaluation_status", "status"), ("rule", "rule_id"))]))
    return report_rows.select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def daily_trend(report_rows: DataFrame, cells: DataFrame, days: int = 9) -> DataFrame:
    """Rows flagged for cells by day, the last ``days`` days that have any."""
    day = cells.select(F.col("consolidation_cell_id").alias("entity_id"), F.substring("round_sort_key", 1, 10).alias("day"))
    flagged = report_rows.where("status = 'FLAGGED' and entity_level in ('CELL', 'SERIES_POINT')")
    return flagged.join(day, "entity_id").groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(days)


def rule_lists(report_rows: DataFrame) -> DataFrame:
    """Per cell: the rules that flag it and those that could not judge it, as arrays."""
    own = report_rows.where("entity_level in ('CELL', 'SERIES_POINT')")
    ids = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("rule_id"))))
    return own.groupBy(F.col("entity_id").alias("consolidation_cell_id")).agg(ids("FLAGGED").alias("flagged_rules"), ids("NOT_EVALUABLE").alias("not_evaluable_rules"))


def series_report(cells: DataFrame) -> DataFrame:
    """Per series: cells by kind, whether its history suffices, what R05 and R06 found,
    and the rounds whose movement asks for a review."""
    there = (F.col("round_alignment") == "ANCHORED") & F.col("fare_cents").isNotNull()
    base = cells.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(there).alias("anchored_priced_rounds"),
        F.count_if(F.col("round_alignment") != "ANCHORED").alias("unaligned_rounds"),
        F.count_if(F.col("fare_cents").isNull()).alias("no_price_cells"),
    )
    flagged, review = F.col("status") == "FLAGGED", F.col("severity").isin("REVIEW", "HIGH")
    rule = lambda r, s: F.count_if((F.col("rule_id") == r) & (F.col("status") == s))
    named = cells.select(F.col("consolidation_cell_id").alias("entity_id"), *SERIES, "collection_round_id")
    found = series_rules(cells).join(named, "entity_id").groupBy(*SERIES).agg(
        *[rule(r, s).alias(f"_{r}_{s}") for r in ("R05", "R06") for s in ("FLAGGED", "NOT_EVALUABLE")],
        F.count_if(flagged & review).alias("persistent_flags"),
        S.packed(F.collect_set(F.when(flagged & review, F.col("collection_round_id")))).alias("persistent_rounds"),
    )
    out = base.join(found, list(SERIES), "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    for r in ("R05", "R06"):
        out = out.withColumns({f"{r.lower()}_evaluable": F.col("anchored_priced_rounds") - zero(f"_{r}_NOT_EVALUABLE"), f"{r.lower()}_flags": zero(f"_{r}_FLAGGED")}).drop(f"_{r}_NOT_EVALUABLE", f"_{r}_FLAGGED")
    status = F.when(F.col("anchored_priced_rounds") <= HISTORY, "INSUFFICIENT_FOR_R05").otherwise("SUFFICIENT_FOR_R05")
    return out.withColumns({"history_status": status, "persistent_flags": zero("persistent_flags"), "persistent_rounds": F.coalesce("persistent_rounds", F.lit(""))})


def source_flags(rows: DataFrame, report_rows: DataFrame) -> DataFrame:
    """Per source: flags on its observations, how many are HIGH, and the flight cells
    and cells it is part of that R07 and R13 flag."""
    # Each report row is worked out once: what it flags meets the rows' ids of all kinds in one join.
    kind = F.when(F.col("entity_level") == "OBSERVATION", F.col("entity_level")).otherwise(F.col("rule_id")).alias("kind")
    hits = report_rows.where("status = 'FLAGGED' and (entity_level = 'OBSERVATION' or rule_id in ('R07', 'R13'))").groupBy(kind, "entity_id").agg(F.count(F.lit(1)).alias("_flags"), F.max(S.rank(F.col("severity"))).alias("_rank"))
    key = lambda k, name: F.struct(F.lit(k).alias("kind"), F.col(name).cast("string").alias("entity_id"))
    mine = rows.select("source", key("OBSERVATION", "observation_id").alias("k"))
    part = rows.select("source", F.explode(F.array(key("R07", "flight_cell_id"), key("R13", "consolidation_cell_id"))).alias("k")).distinct()
    met = mine.unionByName(part).select("source", "k.*").join(hits, ["kind", "entity_id"], "left")
    own = F.when(F.col("kind") == "OBSERVATION", F.col("_flags"))
    hit = lambda k: F.count_if((F.col("kind") == k) & F.col("_flags").isNotNull())
    return met.groupBy("source").agg(
        F.coalesce(F.sum(own), F.lit(0)).alias("flags"),
        F.count_if((F.col("kind") == "OBSERVATION") & (F.col("_rank") == 3)).alias("high_severity_observations"),
        hit("R07").alias("r07_flight_cells"),
        hit("R13").alias("r13_cells"),
    )
