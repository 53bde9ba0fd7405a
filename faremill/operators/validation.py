"""Row rules over raw, all-text observations.

Every rule adds its code to one array in a fixed order; a code may occur twice.  Rows
are annotated, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

AVAILABILITY = ("Available", "Sold Out")
PARTS = ("base_fare", "taxes", "fees")
OPTIONAL = ("departure_time", "base_fare", "taxes", "fees")
NUMBERS = ("advance_purchase_days", "total_fare", *PARTS)


def _parsed() -> dict[str, Column]:
    """What several rules read, parsed once a row in a projection of its own.  Numbers by
    one lambda: it keeps this projection out of the generated method of the rules, which
    would else have more than 8,000 bytes, and the JVM leaves such a method uncompiled."""
    return {"_travel": S.date(F.col("travel_date")), "_captured": S.timestamp(F.col("collection_timestamp")), "_numbers": F.transform(F.array(*NUMBERS), S.number)}


def _codes() -> list[Column]:
    c = F.col
    travel, captured, gap = c("_travel"), c("_captured"), c("_gap")
    days, total, *rest = (c("_numbers")[k] for k in range(len(NUMBERS)))
    parts = dict(zip(PARTS, rest))
    there = lambda n: ~S.is_missing(c(n))
    known = gap.isNotNull() & (gap >= 0)
    rules = [
        ("MISSING_OBSERVATION_ID", ~there("observation_id")),
        ("MISSING_ROUTE", ~there("origin") | ~there("destination")),
        ("ORIGIN_EQUALS_DESTINATION", there("origin") & there("destination") & (F.upper(F.trim("origin")) == F.upper(F.trim("destination")))),
        ("MISSING_CARRIER", ~there("carrier")),
        ("MISSING_FLIGHT_NUMBER", ~there("flight_number")),
        ("MISSING_TRAVEL_DATE", ~there("travel_date")),
        ("IMPOSSIBLE_DATE", there("travel_date") & travel.isNull()),
        ("MISSING_COLLECTION_TIMESTAMP", ~there("collection_timestamp")),
        ("IMPOSSIBLE_DATE", there("collection_timestamp") & captured.isNull()),
        ("INVALID_DEPARTURE_TIME", there("departure_time") & ~S.strict_departure_time(F.trim("departure_time"))),
        ("TRAVEL_DATE_BEFORE_COLLECTION", gap < 0),
        ("ADVANCE_PURCHASE_DAYS_MISMATCH", there("advance_purchase_days") & days.isNotNull() & known & (days != gap)),
        ("NON_NUMERIC_ADVANCE_PURCHASE_DAYS", there("advance_purchase_days") & days.isNull()),
        ("ADVANCE_PURCHASE_WINDOW_MISMATCH", there("advance_purchase_window") & known & (F.trim("advance_purchase_window") != S.expected_window(gap))),
        ("MISSING_FARE_CLASS", ~there("fare_class")),
        ("MISSING_AVAILABILITY_STATUS", ~there("availability_status")),
        ("INVALID_AVAILABILITY_STATUS", there("availability_status") & ~F.trim("availability_status").isin(*AVAILABILITY)),
    ]
    for n, v in parts.items():
        rules += [(f"NON_NUMERIC_{n.upper()}", there(n) & v.isNull()), (f"NEGATIVE_{n.upper()}", v < 0)]
    rules += [
        ("NON_NUMERIC_TOTAL_FARE", there("total_fare") & total.isNull()),
        ("INVALID_TOTAL_FARE", total <= 0),
        ("MISSING_TOTAL_FARE", ~there("total_fare") & (F.trim("availability_status") == "Available")),
        ("TOTAL_FARE_LESS_THAN_COMPONENTS", total < parts["base_fare"] + parts["taxes"] + parts["fees"] - S.COMPONENT_TOLERANCE),
        ("MISSING_SOURCE", ~there("source")),
    ]
    return [F.when(F.coalesce(hit, F.lit(False)), F.lit(code)).otherwise("") for code, hit in rules]


def _given(names: list[Column]) -> Column:
    """Those of the texts that aren't empty.  By ``array_remove``, which is generated code:
    ``array_compact`` is a filter with a lambda, under which all is interpreted."""
    return F.array_remove(F.array(*names), "")


def validate(raw: DataFrame) -> DataFrame:
    """Adds validation_errors (array), validation_status, validation_reason, is_valid."""
    parsed = _parsed()
    out = raw.withColumns(parsed).withColumn("_gap", F.datediff("_travel", F.col("_captured").cast("date")))
    out = out.withColumn("validation_errors", _given(_codes())).drop(*parsed, "_gap")
    missing = _given([F.when(S.is_missing(F.col(n)), F.lit(n)).otherwise("") for n in OPTIONAL])
    status = (
        F.when(F.size("validation_errors") > 0, "INVALID")
        .when(F.trim("availability_status") == "Sold Out", "NON_PRICE_AVAILABILITY")
        .when(F.size(missing) > 0, "VALID_WITH_MISSING_OPTIONAL_FIELDS")
        .otherwise("VALID")
    )
    out = out.withColumn("validation_status", status)
    reason = F.when(F.col("validation_status") == "INVALID", F.array_join("validation_errors", ";")).when(F.col("validation_status") == "VALID_WITH_MISSING_OPTIONAL_FIELDS", F.concat(F.lit("missing: "), F.array_join(missing, ";"))).otherwise(F.lower("validation_status"))
    return out.withColumn("validation_reason", reason).withColumn("is_valid", F.col("validation_status") != "INVALID")


def status_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("validation_status").agg(F.count(F.lit(1)).alias("n"))


def code_counts(validated: DataFrame, top: int | None = None) -> DataFrame:
    """How often each code was given, most frequent first."""
    # The outer form: the plain one filters first, which runs every rule twice over.
    counts = validated.select(F.explode_outer("validation_errors").alias("code")).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "code").limit(top)


#: Expected outcome of each kind of planted edge case: statuses, and a code if INVALID.
EDGE_CASES = {
    "BASELINE": (("VALID", "VALID_WITH_MISSING_OPTIONAL_FIELDS"), None),
    "GENUINE_REPRICE": (("VALID", "VALID_WITH_MISSING_OPTIONAL_FIELDS"), None),
    "DIFFERENT_SOURCE_SAME_PRODUCT": (("VALID", "VALID_WITH_MISSING_OPTIONAL_FIELDS"), None),
    "DIFFERENT_PRODUCT": (("VALID", "VALID_WITH_MISSING_OPTIONAL_FIELDS"), None),
    "DIFFERENT_FLIGHT_SAME_ROUTE_CLASS": (("VALID", "VALID_WITH_MISSING_OPTIONAL_FIELDS"), None),
    "DUPLICATE": (("VALID",), None),
    "STATISTICAL_OUTLIER": (("VALID",), None),
    "MISSING_SUBFIELDS": (("VALID_WITH_MISSING_OPTIONAL_FIELDS",), None),
    "SOLD_OUT": (("NON_PRICE_AVAILABILITY",), None),
    "INVALID_NEGATIVE_FARE": (("INVALID",), "NEGATIVE_BASE_FARE"),
    "MISSING_SOURCE": (("INVALID",), "MISSING_SOURCE"),
    "MISSING_ROUTE": (("INVALID",), "MISSING_ROUTE"),
    "MISSING_TIMESTAMP": (("INVALID",), "MISSING_COLLECTION_TIMESTAMP"),
}


def edge_case_audit(validated: DataFrame, log: DataFrame) -> DataFrame:
    """Left join of the log of planted cases to the verdicts, each judged.  Cases without
    an observation find no verdict; each has a key of its own, as one that all share
    would bring them into one task."""
    verdicts = validated.select(F.col("observation_id").alias("oid"), "validation_status", "validation_errors")
    none = F.coalesce(F.col("observation_id") == "N/A", F.lit(True))
    keyed = log.withColumn("_n", F.monotonically_increasing_id().cast("string")).withColumn("_key", F.when(none, F.concat(F.lit("\0"), "_n")).otherwise(F.col("observation_id")))
    joined = keyed.join(verdicts, F.col("_key") == F.col("oid"), "left").drop("oid", "_key", "_n")
    judged = F.when(F.col("observation_id") == "N/A", "NOT_APPLICABLE").when(F.col("validation_status").isNull(), "NOT_FOUND")
    for category, (statuses, code) in EDGE_CASES.items():
        good = F.col("validation_status").isin(*statuses)
        if code:
            good = good & F.array_contains("validation_errors", code)
        judged = judged.when(F.col("category") == category, F.when(good, "PASS").otherwise("FAIL"))
    return joined.withColumn("audit_result", judged.otherwise("UNKNOWN_CATEGORY"))
