"""Route baskets: traffic ranks, cumulative shares, greedy choice, exact weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

WEIGHT_PLACES = 6
MOST_PLACES = 100_000


def totals(pairs: DataFrame) -> DataFrame:
    """Both directions added up: null where one is missing, and with it as zero."""
    a, b = F.col("passengers_out"), F.col("passengers_back")
    return pairs.withColumns({"total_conservative": a + b, "total_zero_treated": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))})


def eligibility(pairs: DataFrame) -> DataFrame:
    """mapping_status and the first reason that excludes a pair."""
    reason = (
        F.when(F.upper("city_1") == F.upper("city_2"), "SELF_PAIR")
        .when(F.col("passengers_out").isNull() | F.col("passengers_back").isNull(), "MISSING_DIRECTION")
        .when(F.col("code_1").isNull() | F.col("code_2").isNull(), "UNMAPPED_CITY")
    )
    return pairs.withColumn("exclusion_reason", reason).withColumn("mapping_status", F.when(reason.isNull(), "ELIGIBLE").when(reason == "UNMAPPED_CITY", "FLAG_FOR_REVIEW").otherwise("EXCLUDED"))


def ranked(traffic: DataFrame) -> DataFrame:
    """(route_id, passengers) with traffic_rank, running and total passengers and the
    cumulative share in percent.  One row a route."""
    order = Window.orderBy(F.desc("passengers"), "route_id")
    total = F.sum("passengers").over(Window.partitionBy(F.lit(0)))
    running = F.sum("passengers").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return traffic.withColumns({"traffic_rank": F.row_number().over(order), "running_passengers": running, "cumulative_pct": F.round(100 * S.over(running, total), 4)})


def size_analysis(rank: DataFrame, sizes: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """Traffic that baskets of different sizes cover."""
    named = rank.sparkSession.createDataFrame([(n,) for n in sizes], "basket_size int")
    total = rank.agg(F.sum("passengers").alias("all_passengers"))
    top = F.when(F.col("traffic_rank") <= F.col("basket_size"), F.col("passengers"))
    return named.crossJoin(F.broadcast(total)).join(rank, F.col("traffic_rank") <= F.col("basket_size"), "left").groupBy("basket_size").agg(F.sum(top).alias("passengers"), F.round(100 * S.over(F.sum(top), F.max("all_passengers")), 4).alias("covered_pct"))


def diversified(rank: DataFrame, top: int = 10, target: int = 15) -> DataFrame:
    """The busiest ``top`` routes, then the busiest that bring a new region, then a new
    city, up to ``target``: (route_id, selection_stage, basket_rank).

    The choice depends on what was chosen before, so it is made in order on the driver.
    Beyond the top, only the busiest route of a region or city can bring it: an earlier
    one would have been taken, or the region was there.  So a grouping leaves one route a
    region and city to walk over; more than MOST_PLACES of these are an error.
    """
    ends = [f"{kind}_{k}" for kind in ("region", "city") for k in (1, 2)]
    r = rank.select("traffic_rank", "route_id", *ends)
    place = F.explode(F.array(*[F.struct(F.lit(e[:-2]).alias("kind"), F.col(e).cast("string").alias("name")) for e in ends]))
    firsts = r.where(F.col("traffic_rank") > top).select(F.struct(*r.columns).alias("r"), place.alias("p")).groupBy("p").agg(F.min("r").alias("r")).select("r.*").distinct()
    walk = r.where(F.col("traffic_rank") <= top).unionByName(firsts).limit(MOST_PLACES + 1).collect()
    if len(walk) > MOST_PLACES:
        raise ValueError(f"basket: more than {MOST_PLACES} regions and cities")
    chosen, passed, regions, cities = [], [], set(), set()

    def take(r, stage):
        chosen.append((r["route_id"], stage, r["traffic_rank"]))
        regions.update((r["region_1"], r["region_2"]))
        cities.update((r["city_1"], r["city_2"]))

    for r in sorted(walk, key=lambda r: r["traffic_rank"]):
        if len(chosen) < top:
            take(r, "TOP_TRAFFIC")
        elif len(chosen) < target and {r["region_1"], r["region_2"]} - regions:
            take(r, "NEW_REGION")
        else:
            passed.append(r)
    for r in passed:
        if len(chosen) < target and {r["city_1"], r["city_2"]} - cities:
            take(r, "NEW_CITY")
    chosen.sort(key=lambda x: x[2])
    return rank.sparkSession.createDataFrame([(a, b, k + 1) for k, (a, b, _) in enumerate(chosen)], "route_id string, selection_stage string, basket_rank int")


def weighted(basket: DataFrame) -> DataFrame:
    """(route_id, passengers) with basket_rank, full_weight, and traffic_weight to six
    places, whose sum is exactly one: rank one takes the residual."""
    whole = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.desc("passengers"), "route_id")
    out = basket.withColumn("basket_rank", F.row_number().over(order)).withColumn("full_weight", S.over(F.col("passengers"), F.sum("passengers").over(whole)))
    out = out.withColumn("_micro", F.round(F.col("full_weight") * 10**WEIGHT_PLACES).cast("long"))
    rest = F.lit(10**WEIGHT_PLACES) - F.sum("_micro").over(whole)
    residual = F.when(F.col("basket_rank") == 1, rest).otherwise(0)
    out = out.withColumn("residual_micro", residual.cast("long"))
    return out.withColumn("traffic_weight", ((F.col("_micro") + F.col("residual_micro")) / 10**WEIGHT_PLACES).cast("decimal(9,6)")).drop("_micro")


def checked(basket: DataFrame, routes: int | None = None) -> DataFrame:
    """The basket, once its contract holds: unique routes, positive weights, sum one."""
    n, distinct, total, least = basket.agg(F.count(F.lit(1)), F.count_distinct("route_id"), F.sum("traffic_weight"), F.min("traffic_weight")).first()
    if n != distinct or (routes is not None and n != routes) or total != 1 or least <= 0:
        raise ValueError(f"basket: {n} rows, {distinct} routes, weights from {least}, sum {total}")
    return basket
