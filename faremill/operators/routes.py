"""Undirected routes: roll-ups of consolidated cells, with rows for what is missing.

The basket is small (a checked number of routes), so it is broadcast.  Grain A, Grain
B and the coverage report are three groupings of the same cells; none is a median of
another's medians.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .consolidation import in_cells

MAX_BASKET = 10_000


def fixed(basket: DataFrame) -> DataFrame:
    """The basket's rows, computed once and held in the plan, where they are few: what
    joins it then neither counts nor derives it again.  A larger one stays as it is."""
    rows = basket.limit(MAX_BASKET + 1).toArrow()
    return basket.sparkSession.createDataFrame(rows, basket.schema) if rows.num_rows <= MAX_BASKET else basket


def small(basket: DataFrame) -> DataFrame:
    """The basket, broadcast once its size is known to be small.  Rows held in the plan
    (``fixed``) are counted without a job."""
    return F.broadcast(basket) if len(basket.select(F.lit(1)).limit(MAX_BASKET + 1).collect()) <= MAX_BASKET else basket


def route_cells(cells: DataFrame, basket: DataFrame) -> DataFrame:
    """Adds route_id, directed_pair, in_basket and direction_relation."""
    named = small(basket.select("route_id", F.lit(True).alias("in_basket")))
    out = cells.withColumn("route_id", S.route_id(F.col("origin"), F.col("destination"))).withColumn("directed_pair", S.directed_pair(F.col("origin"), F.col("destination")))
    out = out.join(named, "route_id", "left").withColumn("in_basket", F.coalesce("in_basket", F.lit(False)))
    return out.withColumn("direction_relation", S.direction_relation(F.col("directed_pair"), F.when(F.col("in_basket"), F.col("route_id"))))


def measures() -> list:
    priced = F.col("fare_cents").isNotNull()
    return [
        F.count(F.lit(1)).alias("cells"),
        F.count("fare_cents").alias("priced_cells"),
        S.midpoint_cents(F.col("fare_cents")).alias("median_cents"),
        F.min("fare_cents").alias("min_cents"),
        F.max("fare_cents").alias("max_cents"),
        F.sum("observations").alias("observations"),
        F.sum("sold_out_observations").alias("sold_out_observations"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(priced, F.col("sources")))))).cast("long").alias("sources"),
        F.count_distinct("directed_pair").alias("directed_pairs"),
        F.max(S.rank(F.coalesce(F.col("severity"), F.lit("NONE")))).alias("_severity"),
    ]


def _finished(out: DataFrame) -> DataFrame:
    out = out.withColumn("max_severity", S.severity(F.col("_severity"))).drop("_severity")
    return out.withColumn("route_price_state", F.when(F.col("median_cents").isNotNull(), "PRICED").otherwise("NOT_PRICED")).withColumn("spread_cents", F.col("max_cents") - F.col("min_cents"))


ROUND = ("collection_round_id", "round_alignment", "round_sort_key")
GRAIN_A = ("route_id", "fare_class", "advance_purchase_window", "travel_date", *ROUND)
GRAIN_B = ("route_id", "fare_class", *ROUND)


def grain(cells: DataFrame, keys: tuple[str, ...], basket: DataFrame | None = None) -> DataFrame:
    """Measures by ``keys`` of routed cells.  With a basket: one more row, with counts
    of zero and no money, for each of its routes that has no cell."""
    out = _finished(cells.groupBy(*keys).agg(*measures()))
    if basket is None:
        return out.withColumn("coverage_status", F.lit("OBSERVED"))
    idle = basket.select("route_id").join(cells.select("route_id").distinct(), "route_id", "left_anti")
    counts = {n: F.lit(0).cast("long") for n in ("cells", "priced_cells", "observations", "sold_out_observations", "sources", "directed_pairs")}
    idle = idle.withColumns(counts).withColumn("route_price_state", F.lit("NO_OBSERVATIONS")).withColumn("coverage_status", F.lit("NO_OBSERVATIONS"))
    return out.withColumn("coverage_status", F.lit("OBSERVED")).unionByName(idle, allowMissingColumns=True)


def grain_a(routed: DataFrame, basket: DataFrame) -> DataFrame:
    return grain(routed.where("in_basket"), GRAIN_A, basket)


def grain_b(routed: DataFrame, basket: DataFrame) -> DataFrame:
    return grain(routed.where("in_basket"), GRAIN_B, basket)


def off_basket(routed: DataFrame, keys: tuple[str, ...] = GRAIN_A) -> DataFrame:
    return grain(routed.where("not in_basket and route_id is not null"), keys)


def coverage(routed: DataFrame, basket: DataFrame) -> DataFrame:
    """One row a basket route, observed or not, in basket order."""
    seen = _finished(routed.where("in_basket").groupBy("route_id").agg(*measures(), F.bool_and(F.col("directed_pair") == F.col("route_id")).alias("_exact"), F.count_distinct("collection_round_id").alias("rounds")))
    out = basket.select("route_id", "basket_rank", "traffic_weight").join(seen, "route_id", "left")
    status = F.when(F.col("cells").isNull(), "NO_OBSERVATIONS").when(F.col("_exact"), "OBSERVED").otherwise("OBSERVED_VIA_CANONICAL_KEY")
    zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("cells", "priced_cells", "observations", "sources", "directed_pairs", "rounds")}
    return out.withColumn("coverage_status", status).withColumns(zero).drop("_exact")


def crosswalk(routed: DataFrame, basket: DataFrame) -> DataFrame:
    """Cells and observations by directed pair, and basket routes without any."""
    pairs = routed.where("route_id is not null").groupBy("route_id", "directed_pair", "direction_relation", "in_basket").agg(F.count(F.lit(1)).alias("cells"), F.sum("observations").alias("observations"))
    idle = basket.select("route_id").join(routed.select("route_id").distinct(), "route_id", "left_anti").select("route_id", F.lit(None).cast("string").alias("directed_pair"), F.lit("NO_OBSERVATIONS").alias("direction_relation"), F.lit(True).alias("in_basket"), F.lit(0).cast("long").alias("cells"), F.lit(0).cast("long").alias("observations"))
    return pairs.unionByName(idle)


def lineage(routed: DataFrame) -> DataFrame:
    """Which cell went into which row of Grain A."""
    return routed.where("route_id is not null").select(S.key("RSERIES::", *[F.col(k) for k in ("route_id", "fare_class", "advance_purchase_window", "travel_date")]).alias("route_series_id"), "consolidation_cell_id", "collection_round_id", "direction_relation", "fare_cents")


def observation_bundles(rows: DataFrame) -> DataFrame:
    """What went into each cell, from mapped observations: counts and sorted ids.  A
    cell is one product in one round, so its lists are short."""
    ids = lambda c: F.array_sort(F.collect_set(c))
    mine = lambda status: F.when(F.col("participation_status") == status, F.col("observation_id").cast("string"))
    return in_cells(rows).groupBy("consolidation_cell_id").agg(
        F.count(F.lit(1)).alias("mapped_observations"),
        ids(mine("PARTICIPATED")).alias("contributing_ids"),
        ids(mine("EXCLUDED_SOLD_OUT")).alias("excluded_sold_out_ids"),
        F.count_if(S.observation_price_state(F.col("availability_status"), F.col("fare_cents")) == "SOLD_OUT").alias("sold_out_in_bundle"),
        ids(F.col("flight_cell_id")).alias("flight_cell_ids"),
    )


def with_bundles(cells: DataFrame, bundles: DataFrame) -> DataFrame:
    """Every cell with its bundle, an empty one where nothing is mapped to it."""
    out = cells.join(bundles, "consolidation_cell_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({**{n: F.coalesce(n, F.lit(0).cast("long")) for n in ("mapped_observations", "sold_out_in_bundle")}, **{n: F.coalesce(n, none) for n in ("contributing_ids", "excluded_sold_out_ids", "flight_cell_ids")}})


def full_measures(cells: DataFrame, keys: tuple[str, ...] = GRAIN_A) -> DataFrame:
    """All measures of routed cells by ``keys``.  The cells carry bundles, severity, and
    flagged_rules and not_evaluable_rules as arrays.  Every cell counts; none is left
    out for its severity.  The id lists hold every id of a group: use keys of which a
    group is a round or less."""
    fare, sev = F.col("fare_cents"), F.coalesce("severity", F.lit("NONE"))
    review = sev.isin("REVIEW", "HIGH")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    texts = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit(""))))
    listed = {
        "anomaly_rule_ids": union("flagged_rules"),
        "not_evaluable_rule_ids": union("not_evaluable_rules"),
        "market_movement_classes": F.array_sort(F.collect_set(S.market_class(F.col("participating_sources"), F.col("priced_flights")))),
        "contributing_observation_ids": union("contributing_ids"),
        "flight_cell_ids": union("flight_cell_ids"),
        "contributing_travel_dates": texts("travel_date"),
        "contributing_advance_purchase_windows": texts("advance_purchase_window"),
        "consolidation_cell_ids": texts("consolidation_cell_id"),
    }
    out = cells.groupBy(*keys).agg(
        S.midpoint_cents(fare).alias("median_cents"),
        F.min(fare).alias("min_cents"),
        F.max(fare).alias("max_cents"),
        F.count(F.lit(1)).alias("contributing_cells"),
        F.count(fare).alias("priced_cells"),
        *[F.count_if(sev == s).alias(f"{s.lower()}_severity_cells") for s in S.SEVERITIES],
        F.max(S.rank(sev)).alias("_severity"),
        F.count_if(F.size("not_evaluable_rules") > 0).alias("not_evaluable_cells"),
        F.count_if(review).alias("recommended_review_cells"),
        F.sum(F.size("contributing_ids")).alias("contributing_observations"),
        F.sum("sold_out_in_bundle").alias("sold_out_observations"),
        F.sum(F.size("excluded_sold_out_ids")).alias("excluded_sold_out_observations"),
        F.sum("mapped_observations").alias("mapped_observations"),
        *[x.alias(n) for n, x in listed.items()],
    )
    size = lambda n: F.size(n).cast("long")
    out = out.withColumns(
        {
            "unpriced_cells": F.col("contributing_cells") - F.col("priced_cells"),
            "anomaly_excluded_cells": F.lit(0).cast("long"),
            "relative_spread": F.round(S.relative_spread(F.col("min_cents"), F.col("max_cents")), 6),
            "route_price_state": F.when(F.col("median_cents").isNotNull(), "PRICED").otherwise("NOT_PRICED"),
            "max_severity": S.severity(F.col("_severity")),
            "recommended_review": F.col("recommended_review_cells") > 0,
            "contributing_observation_id_count": size("contributing_observation_ids"),
            "flight_cells": size("flight_cell_ids"),
            "travel_dates": size("contributing_travel_dates"),
            "advance_purchase_windows": size("contributing_advance_purchase_windows"),
        }
    )
    return out.withColumns({n: F.array_join(n, ";") for n in listed}).drop("_severity")
