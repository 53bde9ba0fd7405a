"""Comparison of the index with an external monthly series, gated by sample sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The least number of pairs of each metric.
MINIMUM = {
    "LEVEL_DIFFERENCE": 1, "MAE": 6, "RMSE": 6, "BIAS": 6, "MAPE": 6, "DIRECTION": 6, "PEARSON": 12, "SPEARMAN": 12, "SD_INDEX": 12, "SD_REFERENCE": 12,
    "VOLATILITY_RATIO": 12, "TURNING_AGREEMENT": 12, "PEAK_TIMING": 12, "YOY": 12, "LEAD_MINUS_1": 18, "LEAD_0": 18, "LEAD_PLUS_1": 18,
}
#: These are of levels, and their sample is the months; the others are of changes.
LEVELS = ("LEVEL_DIFFERENCE", "MAPE", "PEAK_TIMING")
LEAST_DISTINCT = 3


def month_comparison(periods: DataFrame, reference: DataFrame) -> DataFrame:
    """Full join on the month of (month, level, period_is_partial) with (month,
    reference_level); only complete months match."""
    p = periods.select("month", "level", "period_is_partial")
    out = p.join(reference.select("month", "reference_level"), "month", "full_outer")
    status = (
        F.when(F.col("level").isNull(), "REFERENCE_ONLY")
        .when(F.col("reference_level").isNull(), "INDEX_ONLY_NO_REFERENCE_PERIOD")
        .when(F.col("period_is_partial"), "EXCLUDED_PARTIAL_MONTH")
        .otherwise("MATCHED_COMPLETE_MONTH")
    )
    return out.withColumn("match_status", status)


def pairs(comparison: DataFrame) -> DataFrame:
    """Matched months, both series rebased to the first, with changes from the month
    listed before (list adjacency) and from the calendar month before."""
    m = comparison.where("match_status = 'MATCHED_COMPLETE_MONTH'")
    line = Window.orderBy("month")
    for name, source in (("a", "level"), ("b", "reference_level")):
        m = m.withColumn(name, 100 * S.over(F.col(source), F.first(source).over(line.rowsBetween(Window.unboundedPreceding, 0))))
    for name in ("a", "b"):
        m = m.withColumn(f"d{name}", 100 * S.relative_change(F.lag(name).over(line), F.col(name)))
    next_month = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM") == F.lead("month").over(line)
    return m.withColumn("gap_after", ~F.coalesce(next_month, F.lit(True)))


def _ranked(df: DataFrame, name: str) -> DataFrame:
    order, ties = Window.orderBy(name), Window.partitionBy(name)
    return df.withColumn(f"r{name}", F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def metrics(matched: DataFrame) -> DataFrame:
    """(metric, sample, required, value, status): a value only where the sample and its
    variety suffice.  The pairs are months, so these aggregates are small.

    MAPE is of rebased levels, whose reference must be positive; TURNING_AGREEMENT is
    the share of changes at which both series turn, or neither; PEAK_TIMING the months
    by which the index peaks after the reference (the first peak of either; troughs are
    in ``extreme_timing``); YOY the
    mean absolute difference of the changes over a year.
    """
    line = Window.orderBy("month")
    number = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    year = matched.select((number + 12).alias("_i"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    m = matched.withColumn("_i", number).join(year, "_i", "left")
    m = _ranked(_ranked(m.where("da is not null"), "da"), "db")
    m = m.withColumns({"lead_b": F.lead("db").over(line), "lag_b": F.lag("db").over(line), "prev_a": F.lag("da").over(line), "prev_b": F.lag("db").over(line)})
    e = F.col("da") - F.col("db")
    varied = (F.count_distinct("da") >= LEAST_DISTINCT) & (F.count_distinct("db") >= LEAST_DISTINCT)
    turn = lambda x: F.signum(f"d{x}") * F.signum(f"prev_{x}") < 0
    values = {
        "MAE": F.avg(F.abs(e)),
        "RMSE": F.sqrt(F.avg(e * e)),
        "BIAS": F.avg(e),
        "DIRECTION": 100 * F.avg((F.signum("da") == F.signum("db")).cast("double")),
        "PEARSON": F.when(varied, F.corr("da", "db")),
        "SPEARMAN": F.when(varied, F.corr("rda", "rdb")),
        "SD_INDEX": F.stddev_samp("da"),
        "SD_REFERENCE": F.stddev_samp("db"),
        "VOLATILITY_RATIO": S.over(F.stddev_samp("da"), F.stddev_samp("db")),
        "TURNING_AGREEMENT": 100 * F.avg((turn("a") == turn("b")).cast("double")),
        "YOY": F.avg(F.abs(100 * S.relative_change(F.col("ya"), F.col("a")) - 100 * S.relative_change(F.col("yb"), F.col("b")))),
        "LEAD_MINUS_1": F.when(varied, F.corr("da", "lag_b")),
        "LEAD_0": F.when(varied, F.corr("da", "db")),
        "LEAD_PLUS_1": F.when(varied, F.corr("da", "lead_b")),
    }
    peak = lambda x: -F.max(F.struct(F.col(x), (-number).alias("i")))["i"]
    positive = F.when(F.min("b") <= 0, F.raise_error(F.lit("MAPE needs positive reference levels")).cast("double"))
    levels = {
        "LEVEL_DIFFERENCE": F.avg(F.col("a") - F.col("b")),
        "MAPE": F.coalesce(positive, 100 * F.avg(F.abs(S.over(F.col("a") - F.col("b"), F.col("b"))))),
        "PEAK_TIMING": (peak("a") - peak("b")).cast("double"),
    }

    def tall(rows, exprs):
        row = rows.agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in exprs.items()])
        return row.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(MINIMUM[k]).cast("long").alias("required"), F.col(k).alias("raw")) for k in exprs])).alias("x")).select("n", "x.*")

    out = tall(m, values).unionByName(tall(matched, levels))
    enough = F.col("n") >= F.col("required")
    return out.select("metric", F.col("n").alias("sample"), "required", F.when(enough, F.round("raw", 6)).alias("value"), F.when(~enough, "INSUFFICIENT_SAMPLE").when(F.col("raw").isNull(), "UNDEFINED").otherwise("COMPUTED").alias("status"))


def extreme_timing(matched: DataFrame) -> DataFrame:
    """(extreme, index_month, reference_month, months_apart, sample, status): the first
    peak and the first trough of either series, and the months by which the index's comes
    after the reference's; a value only with as many months as PEAK_TIMING needs."""
    number = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    first = lambda x, sign: F.min_by(F.struct("month", number.alias("i")), F.struct(sign * F.col(x), "month"))
    row = matched.agg(F.count(F.lit(1)).alias("sample"), *[first(x, sign).alias(f"{name}_{x}") for name, sign in (("PEAK", -1), ("TROUGH", 1)) for x in ("a", "b")])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("extreme"), F.col(f"{name}_a").alias("a"), F.col(f"{name}_b").alias("b")) for name in ("PEAK", "TROUGH")]))
    out = row.select("sample", each.alias("x")).select("sample", "x.*")
    enough = F.col("sample") >= MINIMUM["PEAK_TIMING"]
    told = lambda c: F.when(enough, c)
    return out.select("extreme", told(F.col("a.month")).alias("index_month"), told(F.col("b.month")).alias("reference_month"), told(F.col("a.i") - F.col("b.i")).cast("long").alias("months_apart"), "sample", F.when(enough, "COMPUTED").otherwise("INSUFFICIENT_SAMPLE").alias("status"))


def calendar_changes(series: DataFrame) -> DataFrame:
    """(month, value) with the change in percent from the calendar month before and the
    year before; a gap breaks both."""
    first = F.to_date(F.concat("month", F.lit("-01")))
    shifted = lambda n, name: series.select(F.date_format(F.add_months(first, n), "yyyy-MM").alias("month"), F.col("value").alias(name))
    out = series.join(shifted(1, "_m"), "month", "left").join(shifted(12, "_y"), "month", "left")
    return out.select("month", "value", S.percent_change(F.col("value"), F.col("_m")).alias("mom_pct"), S.percent_change(F.col("value"), F.col("_y")).alias("yoy_pct"))


def longest_run_of_days(days: DataFrame) -> DataFrame:
    """(day) -> consecutive_days, missing_days: gaps and islands."""
    d = days.distinct().withColumn("island", F.date_sub("day", F.row_number().over(Window.orderBy("day"))))
    runs = d.groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    gap = F.datediff("a", F.lag("b").over(Window.orderBy("a"))) - 1
    return runs.withColumn("gap", gap).agg(F.max("n").alias("consecutive_days"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("missing_days"))


def gates(round_rows: DataFrame, basket: DataFrame, components: DataFrame, observations: int, real_data: bool) -> DataFrame:
    """Ten production gates, each from data: (gate, observed, required, passed)."""
    primary = round_rows.where("variant = 'PRIMARY'")
    days = longest_run_of_days(primary.select(F.to_date(F.substring("round_sort_key", 1, 10)).alias("day")))
    ends = primary.groupBy(F.substring("round_sort_key", 1, 10).alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") >= len(S.ROUND_ANCHORS)).alias("complete_days"))
    links = primary.agg(F.count(F.lit(1)).alias("rounds"), F.max("routes_represented").alias("routes"), F.max("coverage_pct").alias("coverage"), F.min(F.when(F.col("link_sequence") > 0, F.col("matched_items"))).alias("least_matched"))
    per_route = components.where("variant = 'PRIMARY'").agg(F.coalesce(F.min("matched_items"), F.lit(0)).alias("least_per_route"))
    row = days.crossJoin(ends).crossJoin(links).crossJoin(per_route)
    spec = [
        ("CONSECUTIVE_DAYS", F.col("consecutive_days"), 30, ">="),
        ("ANCHORED_ROUNDS", F.col("rounds"), 72, ">="),
        ("COMPLETE_DAILY_ENDS", F.col("complete_days"), 24, ">="),
        ("ROUTES", F.col("routes"), 12, ">="),
        ("BASKET_WEIGHT_PCT", F.col("coverage"), 80, ">="),
        ("MATCHED_ITEMS_EVERY_LINK", F.col("least_matched"), 30, ">="),
        ("MATCHED_PER_CONTRIBUTING_ROUTE", F.col("least_per_route"), 1, ">="),
        ("VALID_OBSERVATIONS", F.lit(observations), 10_000, ">="),
        ("MISSING_DAYS", F.col("missing_days"), 2, "<="),
        ("REAL_DATA", F.lit(int(real_data)), 1, ">="),
    ]
    items = [F.struct(F.lit(n).alias("gate"), v.cast("double").alias("observed"), F.lit(float(r)).alias("required"), F.coalesce((v >= r) if op == ">=" else (v <= r), F.lit(False)).alias("passed")) for n, v, r, op in spec]
    return row.select(F.explode(F.array(*items)).alias("g")).select("g.*")


def sensitivities(primary: DataFrame, *others: DataFrame) -> DataFrame:
    """Differences of other chains (sensitivity, collection_round_id, other_level) from
    the primary one, by round."""
    base = primary.where("variant = 'PRIMARY'").select("collection_round_id", "index_level")
    out = None
    for o in others:
        j = o.join(base, "collection_round_id").withColumns({"pct_difference": S.percent_change(F.col("other_level"), F.col("index_level")), "point_difference": F.round(F.col("other_level") - F.col("index_level"), 6)})
        out = j if out is None else out.unionByName(j)
    return out


def sensitivity_records(round_rows: DataFrame, components: DataFrame, least_coverage: float = 80.0) -> DataFrame:
    """One row a round and method: how the level would stand under another rule, with its
    status, and the reason where a method gives no level.  Blocked rounds keep their row.

    SENS-COV-01 is the primary chain; 02 weighs a link's routes alike; 03 has only the
    published weights' part of the logarithm, as the missing routes are not imputed; 04
    takes rounds of enough coverage only; SENS-ANOM-01 leaves flagged items out.
    """
    keep = ["link_sequence", "index_level", "pct_change", "routes_represented", "weight_represented"]
    primary = round_rows.where("variant = 'PRIMARY'").select("collection_round_id", "coverage_pct", *keep)
    other = round_rows.where("variant = 'EXCL_REVIEW_HIGH'").select("link_sequence", *[F.col(c).alias(f"x_{c}") for c in keep[1:]])
    parts = components.where("variant = 'PRIMARY'").groupBy("link_sequence").agg(F.avg("mean_log").alias("_equal"), F.sum(F.col("weight") * F.col("mean_log")).alias("_observed"), F.count(F.lit(1)).alias("_routes"))
    line = Window.orderBy("link_sequence")
    base, first = F.col("link_sequence") == 0, F.first("index_level").over(line)
    row = primary.join(parts, "link_sequence", "left").join(other, "link_sequence", "left")
    equal = first * F.exp(F.sum(F.coalesce("_equal", F.lit(0.0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    row = row.withColumns({"_level": equal, "_change": F.when(~base, 100 * (F.exp(F.coalesce("_equal", F.lit(0.0))) - 1))})
    routes = F.when(base, F.col("routes_represented")).otherwise(F.coalesce("_routes", F.lit(0)))
    none, low = F.lit(None), F.coalesce(F.col("coverage_pct"), F.lit(0.0)) < least_coverage
    kinds = ("string", "string", "double", "double", "long", "double", "double", "string", "string")
    names = ("sensitivity_type", "method_id", "alternative_level", "alternative_change_pct", "alternative_routes", "alternative_weight", "observed_log_contribution", "sensitivity_status", "blocked_reason")
    own = (F.col("index_level"), F.col("pct_change"), F.col("routes_represented"), F.col("weight_represented"))
    same = F.col("x_index_level") == F.col("index_level")
    spec = [
        (F.lit("COVERAGE"), F.lit("SENS-COV-01"), *own, none, F.lit("PRIMARY_BASELINE_DIAGNOSTIC"), none),
        (F.lit("COVERAGE"), F.lit("SENS-COV-02"), F.col("_level"), F.col("_change"), routes, F.col("weight_represented"), none, F.lit("DIAGNOSTIC_COMPUTED"), none),
        (F.lit("COVERAGE"), F.lit("SENS-COV-03"), none, none, routes, F.col("weight_represented"), F.coalesce("_observed", F.lit(0.0)), F.lit("LOG_CONTRIBUTION_ONLY_NOT_A_FULL_BASKET_INDEX"), F.lit("MISSING_ROUTES_NOT_IMPUTED")),
        (F.lit("COVERAGE"), F.lit("SENS-COV-04"), *[F.when(~low, c) for c in own[:2]], F.when(low, 0).otherwise(own[2]), own[3], none, F.when(low, "EXCLUDED_LOW_COVERAGE").otherwise("DIAGNOSTIC_COMPUTED"), F.when(low, "LOW_COVERAGE_BELOW_80_PERCENT")),
        (F.lit("ANOMALY"), F.lit("SENS-ANOM-01"), *[F.col(f"x_{c}") for c in keep[1:]], none, F.when(F.col("x_index_level").isNull(), "NO_ALTERNATIVE_CHAIN").when(same, "IDENTICAL_TO_PRIMARY").otherwise("DIFFERS_FROM_PRIMARY"), F.when(F.col("x_index_level").isNull(), "NO_ALTERNATIVE_CHAIN")),
    ]
    each = F.explode(F.array(*[F.struct(*[c.cast(k).alias(n) for c, k, n in zip(cells, kinds, names)]) for cells in spec]))
    out = row.withColumn("s", each).select("collection_round_id", "link_sequence", "index_level", "pct_change", "s.*")
    way = lambda c: F.coalesce(S.direction(F.col(c)), F.lit("BASE"))
    told, plain = F.col("alternative_level").isNotNull(), lambda c, places: F.round(c, places) + 0.0  # noqa: E731  no zero below zero
    return out.select(
        F.concat_ws("::", F.lit("SENS"), "method_id", "collection_round_id").alias("sensitivity_record_id"), "collection_round_id", "sensitivity_type", "method_id",
        F.col("index_level").alias("primary_level"), F.round("alternative_level", 6).alias("alternative_level"), plain(F.col("alternative_level") - F.col("index_level"), 6).alias("level_difference"), plain(100 * S.relative_change(F.col("index_level"), F.col("alternative_level")), 4).alias("level_difference_pct"),
        F.col("pct_change").alias("primary_change_pct"), plain("alternative_change_pct", 4).alias("alternative_change_pct"), plain(F.col("alternative_change_pct") - F.col("pct_change"), 4).alias("change_difference_pp"), way("pct_change").alias("primary_direction"), F.when(told, way("alternative_change_pct")).alias("alternative_direction"),
        "alternative_routes", "alternative_weight", F.round("observed_log_contribution", 10).alias("observed_log_contribution"), "sensitivity_status", "blocked_reason",
    )


#: The least basket coverage of a month, and the least changes.
CPI_COVERAGE, CPI_MAE, CPI_CORRELATION = 80, 6, 12


def cpi_timeline(periods: DataFrame, cpi: DataFrame) -> DataFrame:
    """(month, level, period_is_partial, coverage_pct) with (month, cpi): the complete
    months of enough coverage that both have, rebased to the first, and the changes from
    the calendar month before."""
    p = periods.where(~F.col("period_is_partial") & (F.col("coverage_pct") >= CPI_COVERAGE) & (F.col("level") > 0)).select("month", "level", "coverage_pct")
    m = p.join(cpi.where("cpi > 0").select("month", "cpi"), "month")
    first = lambda c: F.first(c).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumns({"level_rebased": 100 * F.col("level") / first("level"), "cpi_rebased": 100 * F.col("cpi") / first("cpi")})
    after = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")
    m = m.join(m.select(after.alias("month"), F.col("level").alias("_l"), F.col("cpi").alias("_c")), "month", "left")
    m = m.withColumns({"level_mom": 100 * (F.col("level") / F.col("_l") - 1), "cpi_mom": 100 * (F.col("cpi") / F.col("_c") - 1)})
    return m.withColumn("mom_gap", F.col("level_mom") - F.col("cpi_mom")).drop("_l", "_c")


def compare_cpi(timeline: DataFrame) -> DataFrame:
    """(metric, available, required, value, status) of the timeline."""
    gap = F.abs(F.col("mom_gap"))
    n, months = F.count("mom_gap"), F.count(F.lit(1))
    varied = (F.count_distinct(F.round("level_mom", 10)) >= LEAST_DISTINCT) & (F.count_distinct(F.round("cpi_mom", 10)) >= LEAST_DISTINCT)
    alike = F.avg(F.when(F.col("mom_gap").isNotNull(), (F.signum("level_mom") == F.signum("cpi_mom")).cast("double")))
    apart = F.abs(F.col("level_rebased") - F.col("cpi_rebased"))
    spec = [
        ("PEARSON_MOM", n, CPI_CORRELATION, F.when(varied, F.corr("level_mom", "cpi_mom"))),
        ("MEAN_ABSOLUTE_MOM_GAP", n, CPI_MAE, F.avg(gap)),
        ("PEAK_ABSOLUTE_MOM_GAP", n, 1, F.max(gap)),
        ("DIRECTIONAL_AGREEMENT", n, CPI_MAE, 100 * alike),
        ("MAXIMUM_LEVEL_GAP", months, 1, F.max(apart)),
        ("MAPE_REBASED_LEVELS", months, CPI_MAE, 100 * F.avg(apart / F.col("cpi_rebased"))),
    ]
    row = timeline.agg(*[x.alias(f"_{k}_{j}") for j, (_, a, _, v) in enumerate(spec) for k, x in (("n", a), ("v", v))])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"_n_{j}").alias("available"), F.lit(least).cast("long").alias("required"), F.col(f"_v_{j}").alias("v")) for j, (name, _, least, _) in enumerate(spec)])).alias("x")).select("x.*")
    enough = F.col("available") >= F.col("required")
    return out.select("metric", "available", "required", F.when(enough, F.round("v", 6)).alias("value"), F.when(~enough, "INSUFFICIENT_SAMPLE").when(F.col("v").isNull(), "INSUFFICIENT_VARIATION").otherwise("AVAILABLE").alias("status"))


def summary(comparison: DataFrame) -> DataFrame:
    """Spans and counts of both series and of their overlap, in one row."""
    have, ref, both = F.col("level").isNotNull(), F.col("reference_level").isNotNull(), F.col("match_status") == "MATCHED_COMPLETE_MONTH"
    ends = [f(F.when(c, F.col("month"))).alias(f"{n}_{e}") for n, c in (("index", have), ("reference", ref), ("overlap", both)) for f, e in ((F.min, "start"), (F.max, "end"))]
    out = comparison.agg(*ends, F.count_if(have & ~F.coalesce("period_is_partial", F.lit(False))).alias("complete_months"), F.count_if(ref).alias("reference_months"), F.count_if(both).alias("overlapping_levels"))
    return out.withColumns({"overlapping_changes": F.greatest(F.lit(0).cast("long"), F.col("overlapping_levels") - 1), "evaluation_status": F.when(F.col("overlapping_levels") > 0, "OVERLAP_AVAILABLE").otherwise("NO_OVERLAPPING_COMPLETE_PERIODS")})


#: The policies under which coverage is reported; the last one excludes.
COVERAGE_POLICIES = ("SENS-COV-01", "SENS-COV-02", "SENS-COV-03", "SENS-COV-04")


def coverage_policies(coverage: DataFrame, round_rows: DataFrame) -> DataFrame:
    """Routes by rounds of the primary chain under each policy: what the round stands
    for, whether that passes the gate, and why not."""
    r = round_rows.where("variant = 'PRIMARY'").select("collection_round_id", "coverage_pct", "routes_represented", "weight_represented")
    out = coverage.where("variant = 'PRIMARY'").join(r, "collection_round_id").withColumn("coverage_policy_id", F.explode(F.array(*[F.lit(p) for p in COVERAGE_POLICIES])))
    passed = F.coalesce(F.col("coverage_pct") >= CPI_COVERAGE, F.lit(False))
    reason = F.when(passed, None).when(F.col("coverage_policy_id") == COVERAGE_POLICIES[-1], "LOW_COVERAGE_BELOW_80_PERCENT").otherwise("PARTIAL_COVERAGE_DIAGNOSTIC_ONLY")
    return out.withColumns({"relative_available": F.col("matched_items") > 0, "weight_missing": F.round(1 - F.col("weight_represented"), 6), "coverage_gate_passed": passed, "exclusion_reason": reason})


def reference_metadata(series: DataFrame, series_id: str, is_price: bool) -> DataFrame:
    """One row on a (month, value) series: its span, how many values it has and lacks,
    and what it may be compared with.  Traffic is context, never a price."""
    out = series.agg(F.min("month").alias("date_start"), F.max("month").alias("date_end"), F.count(F.lit(1)).alias("observation_count"), (F.count(F.lit(1)) - F.count("value")).alias("missing_value_count"))
    grain = "MONTHLY_COMPLETE_ONLY" if is_price else "COVERAGE_CONTEXT_ONLY"
    return out.select(F.lit(series_id).alias("reference_series_id"), F.lit("PRICE" if is_price else "TRAFFIC_NOT_PRICE").alias("classification"), "*", F.lit(is_price).alias("valid_comparison_target"), F.lit(grain).alias("valid_comparison_grains"))


def metric_lineage(metric_rows: DataFrame, comparison: DataFrame, sensitivity_rows: DataFrame | None = None) -> DataFrame:
    """Which month's value each metric is of, or why it is not: metrics by months of
    either series (both are few), and the rounds of the sensitivities."""
    months = comparison.select("month", "match_status", F.explode(F.array(F.struct(F.lit("INDEX").alias("role"), F.col("level").alias("v")), F.struct(F.lit("REFERENCE").alias("role"), F.col("reference_level").alias("v")))).alias("x")).where("x.v is not null")
    used = F.col("match_status") == "MATCHED_COMPLETE_MONTH"
    out = metric_rows.select("metric").crossJoin(months.select("month", "match_status", "x.*")).select(
        "metric", F.col("role").alias("input_role"), F.col("month").alias("period_id"), F.col("v").alias("source_value"), F.when(~used, F.col("match_status")).alias("exclusion"), F.when(used, "RESOLVED").otherwise("BLOCKED_INPUT_TRACED").alias("lineage_status")
    )
    if sensitivity_rows is None:
        return out
    more = sensitivity_rows.select(F.col("sensitivity").alias("metric"), F.lit("SENSITIVITY").alias("input_role"), F.col("collection_round_id").alias("period_id"), F.col("index_level").alias("source_value"), F.lit(None).cast("string").alias("exclusion"), F.lit("RESOLVED").alias("lineage_status"))
    return out.unionByName(more)
