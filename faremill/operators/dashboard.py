"""Read API and dashboard aggregates: pure functions from tables to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .validation import code_counts

PAGE, MOST = 100, 1000
LEAD_DAYS = (1, 7, 15, 30, 45)
#: The demonstration curve of fares by window.
DEMO_CURVE = {1: 1.35, 7: 1.18, 15: 1.00, 30: 0.88, 45: 0.82}
LOOK_BACK = {"1M": 31, "3M": 92, "6M": 184, "1Y": 366}


def filtered(df: DataFrame, start: str | None = None, end: str | None = None, sort_key: str = "round_sort_key", **equal) -> DataFrame:
    """Equality filters, and an inclusive range on a sort key; None does not filter.
    A parameter that names no column is an error."""
    for name, value in equal.items():
        if name not in df.columns:
            raise ValueError(f"unknown parameter: {name}")
        if value is not None:
            df = df.where(F.col(name) == value)
    if start is not None:
        df = df.where(F.col(sort_key) >= start)
    return df if end is None else df.where(F.col(sort_key) <= end)


def page(df: DataFrame, order: list[str], limit: int = PAGE, offset: int = 0) -> tuple[DataFrame, int, int | None]:
    """(rows of the page, total, next offset or None)."""
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST} and offset 0 or more")
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(limit), total, offset + limit if offset + limit < total else None


def export(df: DataFrame, kind: str, most: int = 10_000) -> list[str]:
    """Lines of an export, JSON or CSV with a header; too many rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    if kind == "json":
        return [r[0] for r in df.select(F.to_json(F.struct("*"))).collect()]
    if kind == "csv":
        return [",".join(df.columns)] + [r[0] for r in df.select(F.to_csv(F.struct("*"))).collect()]
    raise ValueError(f"unknown format: {kind}")


def latest(round_rows: DataFrame) -> DataFrame:
    """The last round of each variant."""
    return round_rows.groupBy("variant").agg(F.max_by(F.struct(*[c for c in round_rows.columns if c != "variant"]), F.struct("round_sort_key", "link_sequence")).alias("r")).select("variant", "r.*")


def last_of_day(round_rows: DataFrame) -> DataFrame:
    return round_rows.groupBy("variant", F.substring("round_sort_key", 1, 10).alias("day")).agg(F.max_by("index_level", "round_sort_key").alias("level"))


def trend(change) -> F.Column:
    return F.when(F.abs(change) < 0.05, "Stable").when(change > 0, "Rising").otherwise("Falling")


def look_back(df: DataFrame, day: str, span: str) -> DataFrame:
    """Rows within a span of days before the last observation."""
    last = df.agg(F.max(day).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(day) > F.date_sub("_last", LOOK_BACK[span])).drop("_last")


def lead_time(fares: DataFrame) -> DataFrame:
    """Average fare by route and window: (route_id, days, average_cents, n)."""
    days = F.regexp_extract("advance_purchase_window", r"^T(\d+)", 1).try_cast("int")
    return fares.where("median_cents is not null").withColumn("days", days).where("days is not null").groupBy("route_id", "days").agg(F.round(F.avg("median_cents"), 4).alias("average_cents"), F.count(F.lit(1)).alias("n"))


def lead_time_pivot(lead: DataFrame) -> DataFrame:
    """Route by window, and the mean of the routes as route ALL."""
    wide = lead.groupBy("route_id").pivot("days", list(LEAD_DAYS)).agg(F.avg("average_cents"))
    mean = lead.groupBy(F.lit("ALL").alias("route_id")).pivot("days", list(LEAD_DAYS)).agg(F.avg("average_cents"))
    out = wide.unionByName(mean)
    return out.select("route_id", *[F.round(F.col(f"`{d}`"), 4).alias(f"t{d}") for d in LEAD_DAYS])


def lead_time_steps(lead: DataFrame) -> DataFrame:
    """From each window to the next: change in percent, arc elasticity, and levels."""
    mean = lead.groupBy("days").agg(F.avg("average_cents").alias("a"))
    line = Window.orderBy("days")
    out = mean.withColumns({"next_days": F.lead("days").over(line), "b": F.lead("a").over(line)}).where("next_days is not null")
    elastic = S.over(F.col("b") - F.col("a"), (F.col("a") + F.col("b")) / 2) / ((F.col("next_days") - F.col("days")) / ((F.col("days") + F.col("next_days")) / 2))
    step = 100 * S.relative_change(F.col("a"), F.col("b"))
    level = F.when(F.abs(elastic) > 0.4, "high").when(F.abs(elastic) > 0.2, "medium").otherwise("low")
    return out.select("days", "next_days", F.round(step, 4).alias("step_pct"), F.when(F.abs(step) > 15, "high").when(F.abs(step) > 7, "medium").otherwise("low").alias("step_level"), F.round(elastic, 6).alias("elasticity"), level.alias("elasticity_level"))


#: Pairs of windows between which a booking step is shown.
STEPS = ((1, 7), (15, 30), (30, 45))


def booking_steps(lead: DataFrame, steps: tuple[tuple[int, int], ...] = STEPS) -> DataFrame:
    """(from_days, to_days, step_pct, step_level) of the named pairs of windows: one row a
    pair, NO_PAIRED_OBSERVATIONS where one of its windows has no fare or the first is zero."""
    means = [F.avg(F.when(F.col("days") == d, F.col("average_cents"))).alias(f"m{d}") for d in sorted({d for pair in steps for d in pair})]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("from_days"), F.lit(b).alias("to_days"), (100 * S.relative_change(F.col(f"m{a}"), F.col(f"m{b}"))).alias("step")) for a, b in steps]))
    out = lead.agg(*means).select(each.alias("x")).select("x.*")
    size = F.abs("step")
    level = F.when(F.col("step").isNull(), "NO_PAIRED_OBSERVATIONS").when(size > 15, "high").when(size > 7, "medium").otherwise("low")
    return out.select("from_days", "to_days", F.round("step", 4).alias("step_pct"), level.alias("step_level"))


def lead_time_extremes(lead: DataFrame) -> DataFrame:
    """Cheapest and dearest window, and the premium of the last day over the first."""
    mean = lead.groupBy("days").agg(F.avg("average_cents").alias("a"))
    at = lambda d: F.max(F.when(F.col("days") == d, F.col("a")))
    return mean.agg(F.min_by("days", "a").alias("cheapest_days"), F.max_by("days", "a").alias("dearest_days"), F.round(100 * S.relative_change(at(LEAD_DAYS[-1]), at(LEAD_DAYS[0])), 4).alias("late_premium_pct"))


def data_quality(validated: DataFrame) -> DataFrame:
    """Counts and shares by verdict."""
    return validated.groupBy("validation_status").agg(F.count(F.lit(1)).alias("n")).withColumn("share_pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def top_issues(validated: DataFrame, top: int = 8) -> DataFrame:
    codes = code_counts(validated)
    return codes.withColumn("share_pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4)).orderBy(F.desc("n"), "code").limit(top)


def route_overview(config: DataFrame, history: DataFrame, live: DataFrame) -> DataFrame:
    """Configured routes with the live fare, else the last one known, in rank order."""
    known = history.groupBy("route_id").agg(F.max_by("median_cents", "round_sort_key").alias("last_cents"))
    quote = live.groupBy("route_id").agg(F.min("fare_cents").alias("live_cents"))
    out = config.join(known, "route_id", "left").join(quote, "route_id", "left")
    source = F.when(F.col("live_cents").isNotNull(), "LIVE").when(F.col("last_cents").isNotNull(), "HISTORY").otherwise("NONE")
    return out.withColumns({"fare_cents": F.coalesce("live_cents", "last_cents"), "fare_source": source})


def route_level(components: DataFrame) -> DataFrame:
    """Level of each route from its own elementary indices; missing ones are skipped."""
    line = Window.partitionBy("variant", "route_id").orderBy("link_sequence").rowsBetween(Window.unboundedPreceding, 0)
    return components.where("route_index > 0").select("variant", "route_id", "link_sequence", F.round(100 * F.exp(F.sum(F.ln("route_index")).over(line)), 6).alias("route_level"))


def compare_levels(series: DataFrame) -> DataFrame:
    """A (month, value) series rebased to its first month."""
    first = F.first("value").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return series.select("month", "value", F.round(100 * S.over(F.col("value"), first), 6).alias("rebased"))


def only(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The whitelisted columns, in the list's order; a missing one is an error."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    return df.select(*columns)


def filter_values(routes: DataFrame) -> DataFrame:
    """(side, code): the distinct ends of (route_id), for the filters."""
    ends = F.explode(F.array(F.struct(F.lit("origin").alias("side"), F.substring_index("route_id", "-", 1).alias("code")), F.struct(F.lit("destination").alias("side"), F.substring_index("route_id", "-", -1).alias("code"))))
    return routes.select(ends.alias("x")).select("x.*").distinct()


def live_quotes(quotes: DataFrame, priority: dict[str, str]) -> DataFrame:
    """(route_id, provider, collected_at, quote_id, fare_cents) -> one quote a route, from
    the first provider in ``priority`` that has any: its first quote (FIRST), or the mean
    of all (MEAN)."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("provider"))
    mean = F.col("provider").isin(*[p for p, how in priority.items() if how == "MEAN"])
    by = quotes.where(place > 0).groupBy("route_id", "provider").agg(F.count(F.lit(1)).alias("n"), F.avg("fare_cents").alias("_mean"), F.min_by("fare_cents", F.struct("collected_at", "quote_id")).alias("_first"))
    by = by.withColumns({"fare": F.round(F.when(mean, F.col("_mean")).otherwise(F.col("_first")) / 100, 2), "quote_count": F.when(mean, F.col("n")).otherwise(1), "_place": place})
    return by.groupBy("route_id").agg(F.min_by(F.struct("provider", "fare", "quote_count"), "_place").alias("q")).select("route_id", "q.*")


def demo_curve(config: DataFrame) -> DataFrame:
    """(route_id, demo_fare) by window, along the demonstration curve."""
    w = F.explode(F.array(*[F.struct(F.lit(f"T{d}").alias("window"), F.lit(m).alias("factor")) for d, m in DEMO_CURVE.items()]))
    return config.withColumn("w", w).select("route_id", F.col("w.window").alias("advance_purchase_window"), F.round(F.col("demo_fare") * F.col("w.factor"), 2).alias("average_fare"), F.lit(2).alias("observation_count"), F.lit("INR").alias("currency"))


def route_changes(history: DataFrame) -> DataFrame:
    """(route_id, round_sort_key, median_cents, min_cents, max_cents, max_severity): each
    route's average in its last round, and the change in percent from the one before."""
    each = history.where("round_sort_key is not null").groupBy("route_id", "round_sort_key").agg(F.avg("median_cents").alias("average_cents"), F.min("min_cents").alias("observed_min"), F.max("max_cents").alias("observed_max"), F.max(S.rank(F.col("max_severity"))).alias("_s"))
    line = Window.partitionBy("route_id").orderBy("round_sort_key")
    each = each.withColumns({"previous_cents": F.lag("average_cents").over(line), "_after": F.lead("round_sort_key").over(line), "_all": F.max("_s").over(Window.partitionBy("route_id"))})
    change = F.round(100 * S.relative_change(F.col("previous_cents"), F.col("average_cents")), 2)
    return each.where("_after is null").withColumns({"change_pct": change, "severity": S.severity(F.coalesce("_all", F.lit(0)))}).drop("_s", "_all", "_after")


def validation_totals(validated: DataFrame) -> DataFrame:
    """One row: records, valid ones, those with errors, those that lack something."""
    codes, n = F.col("validation_errors"), F.count(F.lit(1))
    return validated.agg(
        n.alias("records"),
        F.count_if("is_valid").alias("valid_records"),
        F.count_if(F.size(codes) > 0).alias("records_with_errors"),
        F.count_if(F.exists(codes, lambda x: x.startswith("MISSING_"))).alias("records_with_missing"),
        F.round(S.over(100.0 * F.count_if("is_valid"), n), 2).alias("valid_pct"),
    )


def quality_trend(validated: DataFrame, days: int = 30) -> DataFrame:
    """Share of valid records by day of collection, the last ``days`` days."""
    day = F.substring(F.col("collection_timestamp").cast("string"), 1, 10)
    out = validated.withColumn("day", day).where(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$")).groupBy("day").agg(F.count(F.lit(1)).alias("records"), F.count_if("is_valid").alias("valid_records"))
    return out.withColumn("quality_pct", F.round(100 * F.col("valid_records") / F.col("records"), 4)).orderBy(F.desc("day")).limit(days)


def quote_ranges(quotes: DataFrame) -> DataFrame:
    """Verified quotes above zero by route: least, mean, most, how many."""
    q = quotes.where("fare_cents > 0 and currency = 'INR' and price_status = 'verified'")
    return q.groupBy("route_id").agg(F.min("fare_cents").alias("minimum_cents"), F.round(F.avg("fare_cents"), 2).alias("average_cents"), F.max("fare_cents").alias("maximum_cents"), F.count(F.lit(1)).alias("quote_count"))


#: Sections of the page bundle: the columns that name a row of each.
SECTIONS = {"TOTAL": (), "ROUTE": ("route_id",), "DAY": ("day",), "SEVERITY": ("severity",), "FARE_CLASS": ("fare_class",), "ROUTE_ROUND": ("route_id", "round_sort_key")}


def page_bundle(cells: DataFrame) -> DataFrame:
    """(section, key, measure, value): what the pages show of routed cells, one tall table
    from one scan.  Null members of a key are written as ``-``; a measure without a value,
    such as the mean fare of rows without fares, has no row."""
    rows = cells.withColumns({"day": F.substring("round_sort_key", 1, 10), "severity": F.coalesce("severity", F.lit("NONE"))})
    names = list(dict.fromkeys(c for keys in SECTIONS.values() for c in keys))
    priced = F.col("fare_cents").isNotNull()
    measures = {
        "cells": F.count(F.lit(1)),
        "priced_cells": F.count("fare_cents"),
        "observations": F.sum("observations"),
        "sold_out_observations": F.sum("sold_out_observations"),
        "review_cells": F.count_if(F.col("severity").isin("REVIEW", "HIGH")),
        "average_fare": F.avg("fare_cents") / 100,
        "minimum_fare": F.min("fare_cents") / 100,
        "maximum_fare": F.max("fare_cents") / 100,
        "priced_pct": 100 * F.count_if(priced) / F.count(F.lit(1)),
    }
    # A bit of the grouping id is set for each name that a row is not grouped by.
    absent = {section: sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if c not in keys) for section, keys in SECTIONS.items()}
    grouped = rows.groupingSets([[F.col(c) for c in keys] for keys in SECTIONS.values()], *names).agg(F.grouping_id().alias("_g"), *[m.cast("double").alias(k) for k, m in measures.items()])
    section = F.element_at(F.create_map(*[F.lit(x) for s, g in absent.items() for x in (g, s)]), F.col("_g").cast("int"))
    key = F.coalesce(*[F.when(F.col("_g") == absent[s], F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("-")) for c in keys])) for s, keys in SECTIONS.items()])
    tall = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in measures]))
    return grouped.select(section.alias("section"), key.alias("key"), tall.alias("m")).select("section", "key", "m.measure", "m.value").where("value is not null")
