"""A chained, weighted geometric-mean (Jevons) price index of matched items.

A link joins a round's items with those of the anchored round before it.  The link is
the join key, not a lag over an item: an item that skipped a round is entering.  All
operators take items from ``eligible`` and rounds from ``rounds``; rounds and links
are few, items many, so per-item work stays keyed by (variant, link) and item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .routes import small

VARIANTS = ("PRIMARY", "EXCL_REVIEW_HIGH")
ITEM = ("route_id", "fare_class", "advance_purchase_window", "travel_date")
BASE_LEVEL = 100.0


def eligible(grain_a: DataFrame, variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """Grain A once a variant, with index_eligibility_status and item_id."""
    named = F.explode(F.array(*[F.lit(v) for v in variants]))
    raw = F.trim(F.col("median_cents").cast("string"))  # read from text, it may be blank or no number
    typed = dict(grain_a.dtypes)["median_cents"] != "string"
    grain_a = grain_a.withColumn("_raw", raw).withColumn("median_cents", F.col("median_cents") if typed else raw.try_cast("long"))
    out = grain_a.withColumn("variant", named).withColumn("item_id", S.key("ITEM::", *[F.col(k) for k in ITEM]))
    status = (
        F.when(F.col("route_price_state") == "NO_OBSERVATIONS", "NO_OBSERVATIONS")
        .when(F.col("route_price_state") != "PRICED", "NOT_PRICED")
        .when(F.col("_raw").isNull() | (F.col("_raw") == ""), "MISSING_FARE")
        .when(F.col("median_cents").isNull(), "UNPARSABLE_FARE")
        .when(F.col("median_cents") <= 0, "NON_POSITIVE_FARE")
        .when((F.col("variant") == "EXCL_REVIEW_HIGH") & F.col("max_severity").isin("REVIEW", "HIGH"), "EXCLUDED_REVIEW_HIGH")
        .otherwise("ELIGIBLE")
    )
    return out.withColumn("index_eligibility_status", status).drop("_raw")


def checked(grain_a: DataFrame, basket: DataFrame) -> DataFrame:
    """Grain A, once its contract holds: routes of the basket only, one row an item and
    round, one sort key and alignment a round, positive fares where a row is priced."""
    seen = grain_a.where("route_price_state <> 'NO_OBSERVATIONS'")
    priced, fare = F.col("route_price_state") == "PRICED", F.col("median_cents")
    faults = {
        "a route outside the basket": grain_a.join(small(basket.select("route_id")), "route_id", "left_anti"),
        "an item twice in a round": seen.groupBy(*ITEM, "collection_round_id").count().where("count > 1"),
        "a round with two sort keys or alignments": seen.select("collection_round_id", "round_sort_key", "round_alignment").distinct().groupBy("collection_round_id").count().where("count > 1"),
        "a priced row without a positive fare": seen.where(priced & ~F.coalesce(fare > 0, F.lit(False))),
    }
    for name, rows in faults.items():
        if not rows.isEmpty():
            raise ValueError(f"grain A: {name}")
    return grain_a


def rounds(grain_a: DataFrame) -> DataFrame:
    """Anchored rounds in order: link_sequence from 0, and the round before."""
    order = Window.orderBy("round_sort_key")
    seen = grain_a.where("round_alignment = 'ANCHORED'").select("collection_round_id", "round_sort_key").distinct()
    return seen.withColumn("link_sequence", F.row_number().over(order) - 1).withColumn("previous_round_id", F.lag("collection_round_id").over(order))


def rounds_of(items: DataFrame) -> DataFrame:
    """Rounds with their place in the chain, and the last place that has an eligible item."""
    seen = items.where("round_alignment = 'ANCHORED'").groupBy("collection_round_id", "round_sort_key").agg(F.bool_or(F.col("index_eligibility_status") == "ELIGIBLE").alias("_any"))
    placed = seen.withColumn("link_sequence", F.row_number().over(Window.orderBy("round_sort_key")) - 1)
    return placed.select("collection_round_id", "link_sequence", F.max(F.when(F.col("_any"), F.col("link_sequence"))).over(Window.partitionBy(F.lit(0))).alias("_last"))


def _links(items: DataFrame) -> DataFrame:
    """Every eligible item of every link, with its price in this round and in the one
    before.  An item stands in its own link and in the next one, so one grouping meets
    both prices; nothing is joined with itself.  Link 0 is the base round."""
    now = items.where("index_eligibility_status = 'ELIGIBLE'").join(F.broadcast(rounds_of(items)), "collection_round_id")
    at = lambda step, cur, prev, sev: F.struct((F.col("link_sequence") + step).alias("link"), cur.alias("cur"), prev.alias("prev"), sev.alias("sev"))
    cents, none = F.col("median_cents"), F.lit(None).cast(items.schema["median_cents"].dataType)
    severity = F.coalesce("max_severity", F.lit("NONE")) if "max_severity" in items.columns else F.lit("NONE")
    both = F.explode(F.array(at(0, cents, none, severity), at(1, none, cents, F.lit(None).cast("string"))))
    tall = now.select("variant", "item_id", "route_id", "_last", both.alias("x")).where("x.link <= _last")
    return tall.groupBy("variant", F.col("x.link").alias("link_sequence"), "item_id").agg(
        F.max("route_id").alias("route_id"), F.max("x.cur").alias("current_cents"), F.max("x.prev").alias("previous_cents"), F.max("x.sev").alias("severity")
    )


def _status():
    return F.when(F.col("link_sequence") == 0, "BASE").when(F.col("previous_cents").isNull(), "ENTERING").when(F.col("current_cents").isNull(), "LEAVING").otherwise("MATCHED")


def item_relatives(items: DataFrame) -> DataFrame:
    """Every item of every link: MATCHED with its price relative, ENTERING or LEAVING."""
    relative = F.col("current_cents") / F.col("previous_cents")
    return _links(items).where("link_sequence > 0").select("variant", "link_sequence", "item_id", "route_id", "current_cents", "previous_cents", _status().alias("item_status"), relative.alias("price_relative"))


def unpriced(items: DataFrame) -> DataFrame:
    """Items of anchored rounds that a link leaves out, by reason.  The base round has no
    link."""
    bad = items.where("index_eligibility_status <> 'ELIGIBLE' and round_alignment = 'ANCHORED'").join(F.broadcast(rounds_of(items)), "collection_round_id").where("link_sequence > 0")
    status = F.when(F.col("index_eligibility_status") == "EXCLUDED_REVIEW_HIGH", "EXCLUDED_ANOMALY").otherwise("UNPRICED")
    return bad.select("variant", "link_sequence", "item_id", "route_id", status.alias("item_status"), "index_eligibility_status")


def item_rows(items: DataFrame) -> DataFrame:
    """Every item of every link in one of five states: MATCHED, ENTERING, LEAVING, and
    those a link leaves out, UNPRICED and EXCLUDED_ANOMALY."""
    return item_relatives(items).unionByName(unpriced(items), allowMissingColumns=True)


def _route_counts(items: DataFrame) -> DataFrame:
    """Item counts and mean logarithm of each route in a link, in one grouping."""
    is_ = lambda name: F.count_if(_status() == name)
    return _links(items).groupBy("variant", "link_sequence", "route_id").agg(
        is_("MATCHED").alias("matched_items"),
        is_("ENTERING").alias("entering_items"),
        is_("LEAVING").alias("leaving_items"),
        is_("BASE").alias("base_items"),
        F.avg(F.ln(F.col("current_cents") / F.col("previous_cents"))).alias("mean_log"),
    )


def _route_parts(items: DataFrame, basket: DataFrame) -> DataFrame:
    """Routes of a link with their weight among those there."""
    parts = _route_counts(items).join(small(basket.select("route_id", F.col("traffic_weight").cast("double").alias("weight"))), "route_id")
    there = F.when(F.col("matched_items") + F.col("base_items") > 0, F.col("weight"))
    share = there / F.sum(there).over(Window.partitionBy("variant", "link_sequence"))
    parts = parts.withColumns({"weight": there, "normalized_weight": share})
    return parts.withColumns({"route_index": F.exp("mean_log"), "log_contribution": F.col("normalized_weight") * F.col("mean_log")})


def route_components(items: DataFrame, basket: DataFrame) -> DataFrame:
    """Elementary index of each route in a link, its weight among the routes there, and
    its part of the link's logarithm."""
    return _route_parts(items, basket).where("matched_items > 0").drop("entering_items", "leaving_items", "base_items")


def coverage_status(represented, total):
    return F.when(represented <= 0, "NO_BASKET_COVERAGE").when(represented == total, "FULL_BASKET_COVERAGE").otherwise("PARTIAL_COVERAGE_PROTOTYPE")


def round_index(items: DataFrame, basket: DataFrame) -> DataFrame:
    """Level, factor and coverage of every anchored round and variant.  A link without
    a matched item holds the level; the base round is covered by its eligible items."""
    counts = [F.sum(n).alias(n) for n in ("matched_items", "entering_items", "leaving_items", "weight")]
    links = _route_parts(items, basket).groupBy("variant", "link_sequence").agg(F.sum("log_contribution").alias("log_factor"), F.count("weight").alias("routes"), *counts)
    size = basket.agg(F.count(F.lit(1)).alias("basket_routes"))
    out = rounds(items).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))
    out = out.join(links, ["variant", "link_sequence"], "left").crossJoin(F.broadcast(size))
    line = Window.partitionBy("variant").orderBy("link_sequence")
    total = F.sum(F.coalesce("log_factor", F.lit(0.0))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_level", BASE_LEVEL * F.exp(total))
    routes, weight = F.coalesce("routes", F.lit(0)), F.coalesce("weight", F.lit(0.0))
    return out.select(
        "variant",
        "link_sequence",
        "collection_round_id",
        "round_sort_key",
        "previous_round_id",
        F.round(F.exp("log_factor"), 8).alias("chain_factor"),
        F.round("_level", 6).alias("index_level"),
        S.percent_change(F.col("_level"), F.lag("_level").over(line)).alias("pct_change"),
        F.coalesce("matched_items", F.lit(0)).alias("matched_items"),
        F.coalesce("entering_items", F.lit(0)).alias("entering_items"),
        F.coalesce("leaving_items", F.lit(0)).alias("leaving_items"),
        routes.alias("routes_represented"),
        F.round(weight, 6).alias("weight_represented"),
        F.round(100 * weight, 4).alias("coverage_pct"),
        coverage_status(routes, F.col("basket_routes")).alias("coverage_status"),
    )


def period_index(round_rows: DataFrame, grains: tuple[str, ...] = ("DAILY", "WEEKLY", "MONTHLY")) -> DataFrame:
    """Levels by day, ISO week and month: the last round's level, the mean, and whether
    rounds are missing.  Any partial round makes a period's coverage partial."""
    key = F.col("round_sort_key")
    each = F.array(*[F.struct(F.lit(g).alias("period_grain"), S.period_id(key, g).alias("period_id"), S.expected_rounds(key, g).alias("expected_rounds")) for g in grains])
    tall = round_rows.withColumn("_p", F.explode(each)).select("*", "_p.*").drop("_p")
    out = tall.groupBy("variant", "period_grain", "period_id").agg(
        F.max_by("index_level", "link_sequence").alias("end_level"),
        F.round(F.avg("index_level"), 6).alias("mean_level"),
        F.count(F.lit(1)).alias("rounds"),
        F.max("expected_rounds").alias("expected_rounds"),
        F.sum("matched_items").alias("matched_items"),
        F.min("coverage_pct").alias("min_coverage_pct"),
        F.max("coverage_pct").alias("max_coverage_pct"),
        F.when(F.bool_or(F.col("coverage_status") == "PARTIAL_COVERAGE_PROTOTYPE"), "PARTIAL_COVERAGE_PROTOTYPE").otherwise(F.min_by("coverage_status", "link_sequence")).alias("coverage_status"),
    )
    line = Window.partitionBy("variant", "period_grain").orderBy("period_id")
    return out.withColumns({"period_is_partial": F.col("rounds") < F.col("expected_rounds"), "pct_change": S.percent_change(F.col("end_level"), F.lag("end_level").over(line))})


def index_coverage(items: DataFrame, basket: DataFrame) -> DataFrame:
    """Every basket route in every anchored round and variant: eligible items, matched
    items, whether it contributes.  (Rounds by routes; both are few.)"""
    grid = rounds(items).select("collection_round_id", "link_sequence").crossJoin(basket.select("route_id", "basket_rank", "traffic_weight")).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))
    seen = _route_counts(items).select("variant", "link_sequence", "route_id", (F.col("matched_items") + F.col("entering_items") + F.col("base_items")).alias("eligible_items"), "matched_items")
    out = grid.join(seen, ["variant", "link_sequence", "route_id"], "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("eligible_items", "matched_items")})
    return out.withColumn("contributes", F.when(F.col("link_sequence") == 0, F.col("eligible_items") > 0).otherwise(F.col("matched_items") > 0))


def index_lineage(items: DataFrame, basket: DataFrame) -> DataFrame:
    """Each matched item's weight in its link: its route's over the route's items; they
    sum to one a link."""
    parts = route_components(items, basket).select("variant", "link_sequence", "route_id", "matched_items", "normalized_weight")
    out = item_relatives(items).where("item_status = 'MATCHED'").join(parts, ["variant", "link_sequence", "route_id"])
    return out.withColumn("contribution_weight", F.col("normalized_weight") / F.col("matched_items"))


def unaligned_diagnostics(items: DataFrame) -> DataFrame:
    """For each unaligned round, the anchored round nearest in time (the earlier one on
    a tie), the minutes between, and the items that both have."""
    stray = items.where("round_alignment = 'UNALIGNED'").select("variant", F.col("collection_round_id").alias("stray_id"), F.col("round_sort_key").alias("stray_key")).distinct()
    minutes = lambda k: F.unix_seconds(F.to_timestamp(k, "yyyy-MM-dd HH:mm")) / 60
    day = lambda k: F.substring(k, 1, 10)
    # A row a day: its own anchors (as many as ROUND_ANCHORS), the last one before it and
    # the first one after it.  The nearest anchor of a round is among these.
    anchors = rounds(items).select(day(F.col("round_sort_key")).alias("day"), F.struct(F.col("round_sort_key").alias("key"), F.col("collection_round_id").alias("id")).alias("anchor"))
    by_day = anchors.groupBy("day").agg(F.collect_list("anchor").alias("own"), F.min("anchor").alias("first"), F.max("anchor").alias("last"))
    days = by_day.join(stray.select(day(F.col("stray_key")).alias("day")).distinct(), "day", "full_outer")
    up, down = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", "own", F.last("last", ignorenulls=True).over(up).alias("before"), F.last("first", ignorenulls=True).over(down).alias("after"))
    choice = F.array_compact(F.concat(F.coalesce("own", F.array().cast("array<struct<key:string,id:string>>")), F.array("before", "after")))
    best = F.array_min(F.transform("choice", lambda x: F.struct(F.abs(minutes(x["key"]) - minutes(F.col("stray_key"))).alias("apart"), x["key"].alias("key"), x["id"].alias("id"))))
    near = stray.withColumn("day", day(F.col("stray_key"))).join(days.select("day", choice.alias("choice")), "day").withColumn("best", best)
    near = near.select("variant", "stray_id", F.col("best.id").alias("nearest_round_id"), F.col("best.apart").cast("long").alias("minutes_apart"))
    have = items.where("index_eligibility_status = 'ELIGIBLE'").select("variant", "collection_round_id", "item_id")
    mine = have.withColumnRenamed("collection_round_id", "stray_id")
    theirs = have.select("variant", F.col("collection_round_id").alias("nearest_round_id"), "item_id", F.lit(1).alias("_there"))
    pairs = near.join(mine, ["variant", "stray_id"], "left").join(theirs, ["variant", "nearest_round_id", "item_id"], "left")
    return pairs.groupBy("variant", "stray_id", "nearest_round_id", "minutes_apart").agg(F.count("item_id").alias("items"), F.count("_there").alias("items_in_nearest"))


def rebased(round_rows: DataFrame, base) -> DataFrame:
    """Levels with another round as 100: the round of an id, or the one for which a
    condition holds."""
    at = F.col("collection_round_id") == base if isinstance(base, str) else base
    base = F.max(F.when(at, F.col("index_level"))).over(Window.partitionBy("variant"))
    return round_rows.withColumn("rebased_level", F.round(BASE_LEVEL * S.over(F.col("index_level"), base), 6))


def equal_route_chain(items: DataFrame, basket: DataFrame) -> DataFrame:
    """Sensitivity: every route of a link has the same weight."""
    parts = route_components(items, basket).groupBy("variant", "link_sequence").agg(F.avg("mean_log").alias("log_factor"))
    out = rounds(items).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS]))).join(parts, ["variant", "link_sequence"], "left")
    line = Window.partitionBy("variant").orderBy("link_sequence").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("variant", "link_sequence", "collection_round_id", F.round(BASE_LEVEL * F.exp(F.sum(F.coalesce("log_factor", F.lit(0.0))).over(line)), 6).alias("equal_route_level"))


def locked_weight_chain(items: DataFrame, basket: DataFrame) -> DataFrame:
    """Sensitivity: weights as published, a missing route counts as unchanged."""
    parts = route_components(items, basket).groupBy("variant", "link_sequence").agg(F.sum(F.col("weight") * F.col("mean_log")).alias("log_factor"))
    out = rounds(items).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS]))).join(parts, ["variant", "link_sequence"], "left")
    line = Window.partitionBy("variant").orderBy("link_sequence").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("variant", "link_sequence", "collection_round_id", F.round(BASE_LEVEL * F.exp(F.sum(F.coalesce("log_factor", F.lit(0.0))).over(line)), 6).alias("locked_weight_level"))


def coverage_disclosure(items: DataFrame, basket: DataFrame) -> DataFrame:
    """What of the basket each round of a chain stands for, in eight values."""
    whole = F.broadcast(basket.agg(F.count(F.lit(1)).alias("basket_routes_total"), F.sum(F.col("traffic_weight").cast("double")).alias("_all")))
    r = round_index(items, basket).crossJoin(whole)
    some = F.col("routes_represented") > 0
    return r.select(
        "variant", "link_sequence", F.col("routes_represented").alias("basket_routes_represented"), "basket_routes_total", F.col("weight_represented").alias("basket_weight_represented"), F.round(F.col("_all") - F.col("weight_represented"), 6).alias("basket_weight_missing"),
        F.col("coverage_pct").alias("basket_coverage_pct"), F.when(some, 1.0).otherwise(0.0).alias("effective_weight_sum"), (some & (F.col("routes_represented") < F.col("basket_routes_total"))).alias("renormalization_applied"), "coverage_status",
    )


def severity_counts(items: DataFrame) -> DataFrame:
    """Matched items of each link by the severity of their current price, a column a
    severity and packed."""
    each = [F.count_if(F.col("severity") == n).alias(n.lower()) for n in S.SEVERITIES]
    out = _links(items).where(_status() == "MATCHED").groupBy("variant", "link_sequence").agg(*each)
    return out.withColumn("packed", F.concat_ws(";", *[F.concat(F.lit(f"{n}="), F.col(n.lower()).cast("string")) for n in sorted(S.SEVERITIES)]))


def ordered(round_rows: DataFrame) -> DataFrame:
    """Rounds in the order of their output: variants as listed, then the chain."""
    return round_rows.orderBy(F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("variant")), "link_sequence")
