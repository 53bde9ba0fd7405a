"""Canonical spellings with an audit log: one wide row a row, one tall row an action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

FARE_CLASSES = ("Economy Saver", "Economy Standard", "Economy Flexi")
CARRIERS = ("6E", "AI", "QP", "SG", "UK")
TIER_RANK = {"Economy Saver": 1, "Economy Standard": 2, "Economy Flexi": 3}
MONEY = ("base_fare", "taxes", "fees", "total_fare")
WINDOWS = tuple(label for label, _, _ in S.WINDOW_BANDS)


def normalized(rows: DataFrame, classes: tuple[str, ...] = FARE_CLASSES, sources: tuple[str, ...] = S.EXPECTED_SOURCES, aliases: dict[str, str] | None = None) -> DataFrame:
    """Row by row: canonical class, source, airports and flight number, money to two
    places, price and decomposition states, and ``actions``, an array of (field,
    action, original, normalized) in field order."""
    c = F.col
    out = rows.withColumns({"_class": S.canonical(c("fare_class"), classes, aliases), "_source": S.canonical(c("source"), sources)})
    made = {"origin": S.airport(c("origin")), "destination": S.airport(c("destination")), "flight_number": S.flight_number(c("flight_number"))}
    logs = []

    def log(field, action, old, new, when):
        logs.append(F.when(when, F.struct(F.lit(field).alias("field"), F.lit(action).alias("action"), old.cast("string").alias("original"), new.cast("string").alias("normalized"))))

    for field, struct in (("fare_class", "_class"), ("source", "_source")):
        for action in ("WHITESPACE_NORMALIZED", "ALIAS_APPLIED", "CASE_NORMALIZED", "UNKNOWN_VALUE", "MISSING_VALUE"):
            log(field, action, c(field), c(f"{struct}.value"), F.array_contains(c(f"{struct}.actions"), action))
    for field, new in made.items():
        log(field, "CANONICALIZED", c(field), new, new != c(field))
    for field in MONEY:
        text = c(field).cast("string")
        value = S.money(text)
        log(field, "MONEY_QUANTIZED", text, value, value.isNotNull() & (value.cast("string") != F.trim(text)))
        log(field, "MISSING_VALUE", text, value, S.is_missing(text) | text.isNull())
        log(field, "UNPARSABLE_VALUE", text, value, ~S.is_missing(text) & value.isNull())
    out = out.withColumn("actions", F.array_compact(F.array(*logs)))
    money = {f: S.money(c(f).cast("string")) for f in MONEY}
    out = out.withColumns({**made, **money, "fare_class": c("_class.value"), "source": c("_source.value")}).drop("_class", "_source")
    parts = S.decomposition(*[c(f) for f in MONEY])
    tier = F.create_map(*[F.lit(x) for kv in TIER_RANK.items() for x in kv])
    return out.withColumns({"price_state": S.observation_price_state(c("availability_status"), c("total_fare")), "fare_decomposition_state": parts["state"], "fare_reconciles": parts["reconciles"], "fare_class_tier_rank": F.element_at(tier, c("fare_class"))})


def _flag(name: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(name))


def _named(rows: DataFrame, known: dict[str, tuple[str, ...]]) -> tuple[DataFrame, list[Column]]:
    """<field>_canonical and <field>_is_known of categories, with their flags."""
    values = {f: F.coalesce(S.canonical(F.col(f), names)["value"], F.lit("")) for f, names in known.items()}
    rows = rows.withColumns({f"{f}_canonical": v for f, v in values.items()})
    rows = rows.withColumns({f"{f}_is_known": F.col(f"{f}_canonical").isin(*names) for f, names in known.items()})
    flags = []
    for f in known:
        empty = F.col(f"{f}_canonical") == ""
        flags += [_flag(f"MISSING_{f.upper()}", empty), _flag(f"UNKNOWN_{f.upper()}", ~empty & ~F.col(f"{f}_is_known"))]
    return rows, flags


def _identity(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Canonical identity beside the given one; the direction of a route and the band
    of a row stay as they are."""
    c = F.col
    rows, flags = _named(rows, {"fare_class": FARE_CLASSES})
    tier = F.create_map(*[F.lit(x) for kv in TIER_RANK.items() for x in kv])
    tidy = F.trim(c("travel_date").cast("string"))
    day = F.date_format(S.date(tidy), "yyyy-MM-dd")
    window = F.coalesce(S.canonical(c("advance_purchase_window"), WINDOWS)["value"], F.lit(""))
    rows = rows.withColumns({
        "origin_canonical": F.coalesce(S.airport(c("origin")), F.lit("")),
        "destination_canonical": F.coalesce(S.airport(c("destination")), F.lit("")),
        "travel_date_canonical": F.coalesce(day, tidy, F.lit("")),
        "fare_class_tier_rank": F.element_at(tier, c("fare_class_canonical")),
        "advance_purchase_window_is_known": window.isin(*WINDOWS),
    })
    flags += [_flag(f"MISSING_{f.upper()}", c(f"{f}_canonical") == "") for f in ("origin", "destination")]
    flags.append(_flag("INVALID_TRAVEL_DATE_FORMAT", (tidy != "") & day.isNull()))
    flags.append(_flag("UNKNOWN_ADVANCE_PURCHASE_WINDOW", (window != "") & ~c("advance_purchase_window_is_known")))
    return rows, flags


def _keyed(rows: DataFrame, flags: list[Column], anchor: Column) -> DataFrame:
    """Adds the sort key of the round, its origin, the currency and the flags."""
    key = S.round_sort_key(anchor, F.col("collection_round_id"))
    key = F.coalesce(key, F.nullif(F.regexp_extract("collection_round_id", r"^ROUND-(\d{4}-.*)$", 1), F.lit("")))
    source = F.when(anchor.isNotNull(), "ANCHOR_TIMESTAMP").when(key.isNotNull(), "ROUND_ID").otherwise("UNRESOLVED")
    flags = [*flags, _flag("MISSING_ROUND_SORT_KEY", key.isNull())]
    return rows.withColumns({"round_sort_key": key, "round_sort_key_source": source, "currency": F.lit("INR"), "normalization_flags": S.packed(F.array_compact(F.array(*flags)), "|")})


def normalized_cells(cells: DataFrame) -> DataFrame:
    """Consolidated cells, one row each, with canonical identity and flags."""
    rows, flags = _identity(cells)
    rows = rows.withColumns({"consolidated_fare_normalized": (F.col("fare_cents") / 100).cast("decimal(18,2)"), "price_state": S.cell_price_state(F.col("consolidation_status"), F.col("fare_cents"))})
    flags.append(_flag("MISSING_PRICE", F.col("price_state") == "NO_PRICE_CELL"))
    return _keyed(rows, flags, F.col("round_anchor_timestamp"))


def _flown(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    rows, flags = _named(rows, {"carrier": CARRIERS})
    given = F.col("departure_time_normalized")
    time = S.departure_time(given)
    rows = rows.withColumns({"flight_number_canonical": F.coalesce(S.flight_number(F.col("flight_number")), F.lit("")), "departure_time_canonical": F.coalesce(time, F.lit(""))})
    return rows, [*flags, _flag("INVALID_DEPARTURE_TIME", ~S.is_missing(given) & time.isNull())]


def normalized_flight_cells(flights: DataFrame) -> DataFrame:
    """Flight cells, one row each; their rounds are known by id alone."""
    rows, flags = _identity(flights)
    rows, more = _flown(rows)
    state = S.flight_price_state(F.col("flight_cents"), F.col("sold_out_observations"), F.col("priced_observations"))
    rows = rows.withColumns({"flight_representative_fare_normalized": (F.col("flight_cents") / 100).cast("decimal(18,2)"), "price_state": state})
    return _keyed(rows, flags + more, F.lit(None).cast("string"))


def normalized_map(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Mapped observations, one row each, with the fare parts of their canonical row.
    The parts are checked against the map's own total and never made up; an id that
    ``canonical`` lacks has none.  Ids are unique there."""
    c = F.col
    parts = canonical.select("observation_id", *[S.money(c(n).cast("string")).alias(n) for n in MONEY[:3]])
    rows, flags = _identity(rows.drop(*MONEY[:3]).join(parts, "observation_id", "left"))
    rows, more = _flown(rows)
    rows, named = _named(rows, {"source": S.EXPECTED_SOURCES})
    total, stamp = c("total_fare").cast("string"), c("collection_timestamp").cast("string")
    rows = rows.withColumns({"total_fare_normalized": S.money(total), "collection_timestamp_iso": S.timestamp_text(c("collection_ts"))})
    d = S.decomposition(*[c(n) for n in MONEY[:3]], c("total_fare_normalized"))
    rows = rows.withColumns({"fare_decomposition_complete": d["state"] == "COMPLETE", "fare_components_reconcile": d["reconciles"], "price_state": S.observation_price_state(c("availability_status"), c("total_fare_normalized"))})
    flags += [
        *more,
        *named,
        _flag("MISSING_COLLECTION_TIMESTAMP", S.is_missing(stamp)),
        _flag("UNPARSEABLE_COLLECTION_TIMESTAMP", ~S.is_missing(stamp) & c("collection_ts").isNull()),
        _flag("UNPARSEABLE_MONETARY_VALUE", ~S.is_missing(total) & c("total_fare_normalized").isNull()),
        _flag("FARE_DECOMPOSITION_INCOMPLETE", ~c("fare_decomposition_complete")),
        _flag("FARE_COMPONENTS_MISMATCH", ~c("fare_components_reconcile")),
        _flag("MISSING_PRICE", c("price_state") == "MISSING_PRICE"),
    ]
    return _keyed(rows, flags, c("round_anchor_timestamp"))


def report(rows: DataFrame, entity: str, entity_id: str) -> DataFrame:
    """The tall audit log: one row an entity, field and action."""
    return rows.select(F.lit(entity).alias("entity_type"), F.col(entity_id).cast("string").alias("entity_id"), F.explode("actions").alias("a")).select("entity_type", "entity_id", "a.*")
