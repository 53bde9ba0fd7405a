"""Three-stage exact medians: within a source, across sources, across flights.

Each stage is its own grouping of integer cents, rounded half a cent up, so a source
with many captures has one vote, and a product listed on many flights one fare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

PRODUCT = ("origin", "destination", "travel_date", "fare_class", "advance_purchase_window")
FLIGHT = ("carrier", "flight_number", "departure_time")
ROUND = ("collection_round_id", "round_alignment", "round_anchor_timestamp")
COUNTS = ("observations", "priced_observations", "sold_out_observations", "missing_observations")


def members(canonical: DataFrame) -> DataFrame:
    """Adds round columns, participation_status, fare_cents, and the ids of the cell
    and flight cell (null outside any cell)."""
    c = F.col
    kinds = dict(canonical.dtypes)
    text = lambda n: F.coalesce(c(n).cast("string"), F.lit(""))
    typed = kinds["collection_timestamp"].startswith("timestamp")
    out = canonical.withColumn("collection_ts", c("collection_timestamp").cast("timestamp_ntz") if typed else S.timestamp(text("collection_timestamp")))
    out = out.withColumn("_round", S.collection_round(c("collection_ts"), c("observation_id")))
    out = out.withColumns({"collection_round_id": c("_round.round_id"), "round_alignment": c("_round.alignment"), "round_anchor_timestamp": c("_round.anchor")}).drop("_round")
    out = out.withColumn("fare_cents", S.cents(c("total_fare") if kinds["total_fare"].startswith("decimal") else S.money(text("total_fare"))))
    blank = None
    for n in PRODUCT:
        one = S.is_missing(text(n)) if kinds[n] == "string" else c(n).isNull()
        blank = one if blank is None else blank | one
    sold = F.coalesce(S.is_sold_out(c("availability_status")), F.lit(False))
    out = out.withColumn("in_cell", c("collection_ts").isNotNull() & ~S.is_missing(text("source")) & ~blank)
    out = out.withColumn("priced", c("in_cell") & ~sold & c("fare_cents").isNotNull())
    status = (
        F.when(c("priced"), "PARTICIPATED")
        .when(c("in_cell"), F.when(sold, "EXCLUDED_SOLD_OUT").otherwise("EXCLUDED_MISSING_PRICE"))
        .when(c("collection_ts").isNull(), "EXCLUDED_NO_ROUND")
        .when(S.is_missing(text("source")), "EXCLUDED_MISSING_SOURCE")
        .otherwise("EXCLUDED_MISSING_IDENTITY")
    )
    out = out.withColumn("participation_status", status)
    cell = F.concat(S.key("CELL::", *[c(n) for n in PRODUCT]), F.lit("::"), c("collection_round_id"))
    out = out.withColumn("consolidation_cell_id", F.when(c("in_cell"), cell))
    time = S.departure_time(text("departure_time"))
    out = out.withColumn("departure_time_normalized", time)
    return out.withColumn("flight_cell_id", F.when(c("in_cell"), F.concat(c("consolidation_cell_id"), S.key("::FLT::", c("carrier"), c("flight_number"), c("departure_time_normalized")))))


def in_cells(rows: DataFrame) -> DataFrame:
    """Mapped rows that are in a cell.  Their ids can't be null by type: joins on ids that
    can test for nulls, and such a test goes down to the scan, where the ids are worked out
    anew, by a method of more than 8,000 bytes, which the JVM leaves uncompiled."""
    return rows.where("in_cell").withColumns({n: F.coalesce(n, F.lit("")) for n in ("consolidation_cell_id", "flight_cell_id")})


def source_values(rows: DataFrame) -> DataFrame:
    """Stage 0: one value a flight cell and source, with the counts and extremes that
    the later stages add up.  A cell's attributes follow from its id, so any will do."""
    ts, priced = F.unix_seconds(F.col("collection_ts").cast("timestamp")), F.col("priced")
    is_ = lambda name: F.count_if(F.col("participation_status") == name)
    fare = F.when(priced, F.col("fare_cents"))
    return in_cells(rows).groupBy("consolidation_cell_id", "flight_cell_id", "source").agg(
        *[F.min(n).alias(n) for n in (*PRODUCT, *FLIGHT[:2], "departure_time_normalized", *ROUND)],
        S.midpoint_cents(fare).alias("source_cents"),
        F.count(F.lit(1)).alias("observations"),
        F.count_if(priced).alias("priced_observations"),
        is_("EXCLUDED_SOLD_OUT").alias("sold_out_observations"),
        is_("EXCLUDED_MISSING_PRICE").alias("missing_observations"),
        F.min(fare).alias("min_cents"),
        F.max(fare).alias("max_cents"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
    )


def _totals() -> list:
    return [*[F.sum(n).alias(n) for n in COUNTS], *[F.min(n).alias(n) for n in ("min_cents", "_first", *PRODUCT, *ROUND)], *[F.max(n).alias(n) for n in ("max_cents", "_last")]]


def flight_cells(rows: DataFrame) -> DataFrame:
    """Stage 1, with every flight cell, priced or not."""
    there = F.col("source_cents").isNotNull()
    out = source_values(rows).groupBy("consolidation_cell_id", "flight_cell_id").agg(
        *_totals(),
        *[F.min(n).alias(n) for n in (*FLIGHT[:2], "departure_time_normalized")],
        S.midpoint_cents(F.col("source_cents")).alias("flight_cents"),
        F.nullif(F.count("source_cents"), F.lit(0)).alias("priced_sources"),
        (F.max("source_cents") - F.min("source_cents")).alias("source_spread_cents"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(there, F.struct("source", "source_cents"))))).alias("source_fares"),
        F.collect_set("source").alias("seen_sources"),
    )
    state = S.flight_price_state(F.col("flight_cents"), F.col("sold_out_observations"), F.col("priced_observations"))
    return out.withColumns({"flight_price_state": state, "source_fares": F.when(F.size("source_fares") > 0, F.col("source_fares"))})


def cells(rows: DataFrame) -> DataFrame:
    """Stage 2, dispersion, coverage and status of every consolidation cell; one chain
    of groupings, from the stages before."""
    return _cells(flight_cells(rows))


def _cells(flights: DataFrame, *more) -> DataFrame:
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = flights.groupBy("consolidation_cell_id").agg(
        *_totals(),
        *more,
        S.midpoint_cents(F.col("flight_cents")).alias("fare_cents"),
        F.count(F.lit(1)).alias("flights"),
        F.count("flight_cents").alias("priced_flights"),
        F.max("source_spread_cents").alias("max_flight_source_spread_cents"),
        S.midpoint_cents(F.col("source_spread_cents")).alias("median_flight_source_spread_cents"),
        (F.max("flight_cents") - F.min("flight_cents")).alias("cross_flight_spread_cents"),
        flat(F.map_keys("source_fares")).alias("sources"),
        flat(F.col("seen_sources")).alias("seen_sources"),
    )
    out = out.withColumn("round_time_spread_minutes", F.floor((F.col("_last") - F.col("_first")) / 60).cast("long")).drop("_first", "_last")
    n = F.size("sources")
    expected = F.array(*[F.lit(s) for s in S.EXPECTED_SOURCES])
    status = F.when(F.col("fare_cents").isNotNull(), "CONSOLIDATED").when(F.col("sold_out_observations") == F.col("observations"), "NO_PRICE_ALL_SOLD_OUT").when(F.col("missing_observations") == F.col("observations"), "NO_PRICE_ALL_MISSING").otherwise("NO_PRICE_NO_USABLE_FARE")
    return out.withColumns(
        {
            "consolidation_status": status,
            "participating_sources": n.cast("long"),
            "source_coverage": S.source_coverage(n),
            "source_coverage_ratio": F.round(n / len(S.EXPECTED_SOURCES), 4),
            "missing_sources": F.array_except(expected, F.col("sources")),
            "price_state": S.cell_price_state(status, F.col("fare_cents")),
            "round_sort_key": S.round_sort_key(F.col("round_anchor_timestamp"), F.col("collection_round_id")),
            "cross_flight_relative_spread": S.ratio_half_even(S.over(F.col("cross_flight_spread_cents"), F.col("fare_cents"))).cast("double"),
        }
    )


def source_first(rows: DataFrame) -> DataFrame:
    """Diagnostic: the median of each source over its flights, then over sources."""
    per_source = rows.where("priced").groupBy("consolidation_cell_id", "source").agg(S.midpoint_cents(F.col("fare_cents")).alias("c"))
    return per_source.groupBy("consolidation_cell_id").agg(S.midpoint_cents(F.col("c")).alias("source_first_cents"))


def observation_map(rows: DataFrame) -> DataFrame:
    """Every observation with the medians of its flight cell and cell.  Cells carry their
    flights along, so that both come from one chain of groupings and one join."""
    each = _cells(flight_cells(rows), F.collect_list(F.struct("flight_cell_id", "flight_cents")).alias("_flights"))
    each = each.select(F.col("fare_cents").alias("cell_cents"), "consolidation_status", F.inline("_flights"))
    return rows.join(each, "flight_cell_id", "left")


def with_decomposition(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Mapped observations with the fare parts of their canonical row, looked up by id,
    and whether these are complete and add up."""
    parts = canonical.select("observation_id", *[S.money(F.col(n).cast("string")).alias(n) for n in ("base_fare", "taxes", "fees", "total_fare")])
    out = rows.drop("base_fare", "taxes", "fees", "total_fare").join(parts, "observation_id", "left")
    d = S.decomposition(*[F.col(n) for n in ("base_fare", "taxes", "fees", "total_fare")])
    return out.withColumns({"decomposition_state": d["state"], "decomposition_reconciles": d["reconciles"]})
