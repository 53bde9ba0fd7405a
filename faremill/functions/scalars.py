"""Scalar column functions: missing values, parsing, rounding, identity, severity.

All are built-in expressions, so they stay inside generated code.  Money is
``decimal(18,2)`` at the edge and integer cents where medians are taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
# Advance-purchase bands: label, least and most days (there are gaps between them).
WINDOW_BANDS = (("T1(0-2)", 0, 2), ("T7(5-9)", 5, 9), ("T15(12-18)", 12, 18), ("T30(25-35)", 25, 35), ("T45(40-50)", 40, 50))
OUT_OF_BAND = "OUT_OF_BAND"
ROUND_ANCHORS = ("09:00", "14:30", "20:15")
ROUND_TOLERANCE_MINUTES = 30
DUPLICATE_TOLERANCE_MINUTES = 15
COMPONENT_TOLERANCE = 1.00
EXPECTED_SOURCES = ("AirlineSite", "Cleartrip", "Goibibo", "MMT")
SEVERITIES = ("NONE", "INFO", "REVIEW", "HIGH")
MISSING_MARKER = "<MISSING>"
RETRIED, MOST_ATTEMPTS = (408, 425, 500, 502, 503, 504), 3
PRICE_UNITS = {"PRICE_UNIT_WHOLE": 1, "PRICE_UNIT_CENTI": 100, "PRICE_UNIT_MILLI": 1000, "PRICE_UNIT_MICRO": 1000000}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


# --- missing values and text ---------------------------------------------------
def blank_to_null(c: Column, nan: bool = False) -> Column:
    """Null for blank text, and for the literal nan where ``nan`` is asked for."""
    out = F.nullif(F.trim(c), F.lit(""))
    return F.when(F.lower(out) != "nan", out) if nan else out


def is_missing(c: Column, nan: bool = False) -> Column:
    return blank_to_null(c, nan).isNull() if nan else F.coalesce(F.trim(c) == "", F.lit(True))


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def canonical(c: Column, known: tuple[str, ...], aliases: dict[str, str] | None = None) -> Column:
    """struct(value, actions): trim and collapse, alias, exact, case-folded, else
    unknown; actions in the order in which they applied."""
    tidy = clean(c)
    named = {k.lower(): k for k in known} | {k.lower(): v for k, v in (aliases or {}).items()}
    table = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    value = F.element_at(table, F.lower(tidy))
    actions = F.array_compact(
        F.array(
            F.when(tidy != c, F.lit("WHITESPACE_NORMALIZED")),
            F.when(F.lower(tidy).isin(*[k.lower() for k in (aliases or {"\0": ""})]), F.lit("ALIAS_APPLIED")),
            F.when(value.isNotNull() & (value != tidy) & ~F.lower(tidy).isin(*[k.lower() for k in (aliases or {"\0": ""})]), F.lit("CASE_NORMALIZED")),
            F.when(value.isNull() & (tidy != ""), F.lit("UNKNOWN_VALUE")),
            F.when(tidy == "", F.lit("MISSING_VALUE")),
        )
    )
    return F.struct(F.coalesce(value, tidy).alias("value"), actions.alias("actions"))


def airport(c: Column) -> Column:
    return F.upper(clean(c))


def flight_number(c: Column) -> Column:
    return F.upper(clean(c))


# --- numbers -------------------------------------------------------------------
def number(c: Column) -> Column:
    """Null on junk; currency signs and separators are junk."""
    tidy = F.trim(c)
    return F.when(tidy.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), tidy.try_cast("double"))


def money(c: Column) -> Column:
    """Decimal, two places, half up; null on junk.  Junk without a digit isn't tried, as
    each failure costs an exception."""
    tidy = F.trim(c)
    return F.round(F.when(tidy.rlike(r"\p{Nd}"), tidy.try_cast("decimal(20,6)")), 2).cast("decimal(18,2)")


def integer(c: Column) -> Column:
    """The whole part of a number in text, cut towards zero; null on junk."""
    n = F.trim(c).try_cast("decimal(38,6)")
    return F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")


def strict_money(c: Column) -> Column:
    """Money that must parse: junk raises, blank is null."""
    tidy = blank_to_null(c)
    return F.when(tidy.isNull(), F.lit(None)).when(tidy.try_cast("decimal(18,4)").isNull(), F.raise_error(F.concat(F.lit("not a number: "), tidy)).cast("decimal(18,2)")).otherwise(F.round(tidy.try_cast("decimal(18,4)"), 2).cast("decimal(18,2)"))


def strict_boolean(c: Column) -> Column:
    """Exactly True or False; blank is null, anything else raises."""
    return F.when(is_missing(c), F.lit(None)).when(c == "True", F.lit(True)).when(c == "False", F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def fare_text(c: Column) -> Column:
    """5400 for 5400.00 and 5400.5 for 5400.50: equal fares render alike."""
    return F.regexp_replace(F.regexp_replace(money(c).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def midpoint_cents(c: Column) -> Column:
    """Exact median of integer cents, half a cent rounded up (aggregate)."""
    return F.floor(F.median(c) + 0.5).cast("long")


def ratio_half_up(c: Column, places: int = 6) -> Column:
    return F.round(c.cast("decimal(38,18)"), places)


def ratio_half_even(c: Column, places: int = 6) -> Column:
    return F.bround(c.cast("decimal(38,18)"), places)


def over(a: Column, b: Column) -> Column:
    """a / b; null over a base of zero, from which no ratio is defined."""
    return a / F.when(b != 0, b)


def relative_change(previous: Column, current: Column) -> Column:
    return over(current - previous, previous)


def percent_change(current: Column, previous: Column) -> Column:
    return F.round(100 * over(current - previous, previous), 4)


def relative_spread(least: Column, most: Column) -> Column:
    return F.when(least > 0, (most - least) / least)


def direction(c: Column) -> Column:
    return F.when(c > 0, "UP").when(c < 0, "DOWN").when(c == 0, "ZERO")


# --- dates and times -------------------------------------------------------------
def date(c: Column) -> Column:
    """Year-month-day with one or two digits, from 2000 to 2100."""
    tidy = F.trim(c)
    parsed = F.when(tidy.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), tidy.try_cast("date"))
    return F.when(F.year(parsed).between(2000, 2100), parsed)


def timestamp(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss")) -> Column:
    """Naive local timestamp in the first format that fits."""
    tidy = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(tidy, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def departure_time(c: Column) -> Column:
    """HH:MM of H:MM, HH:MM:SS or HH:MM:SS.f; seconds are cut, junk is null."""
    pattern = r"^(\d{1,2}):(\d{2})(:\d{2}(\.\d+)?)?$"
    hour, minute = F.regexp_extract(F.trim(c), pattern, 1), F.regexp_extract(F.trim(c), pattern, 2)
    good = F.trim(c).rlike(pattern) & (hour.try_cast("int") < 24) & (minute.try_cast("int") < 60)
    return F.when(good, F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def strict_departure_time(c: Column) -> Column:
    return c.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")


def expected_window(days: Column) -> Column:
    first, *rest = WINDOW_BANDS
    out = F.when(days.between(first[1], first[2]), first[0])
    for label, least, most in rest:
        out = out.when(days.between(least, most), label)
    return F.when(days.isNotNull(), out.otherwise(OUT_OF_BAND))


def collection_round(ts: Column, observation_id: Column) -> Column:
    """struct(round_id, alignment, anchor): the nearest anchor of the day within 30
    minutes, the earlier one on a tie; else a round of its own.

    Comparisons with fixed bounds and one text for each part: as an array of gaps, this
    and what stands beside it made generated methods of more than 8,000 bytes, which the
    JVM leaves uncompiled."""
    minute = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60
    at = [int(a[:2]) * 60 + int(a[3:]) for a in ROUND_ANCHORS]
    near = None
    for k, (m, a) in enumerate(zip(at, ROUND_ANCHORS)):
        last = min([m + ROUND_TOLERANCE_MINUTES, *[(m + n) / 2 for n in at[k + 1 : k + 2]]])
        near = (F if near is None else near).when(minute.between(m - ROUND_TOLERANCE_MINUTES, last), a)
    anchor = F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" "), near)
    alone = F.when(ts.isNull(), F.concat(F.lit("ROUND-UNRESOLVED::"), observation_id)).otherwise(F.concat(F.lit("ROUND-UNALIGNED::"), F.date_format(ts, "yyyy-MM-dd HH:mm")))
    alignment = F.when(ts.isNull(), "UNRESOLVED").when(anchor.isNotNull(), "ANCHORED").otherwise("UNALIGNED")
    return F.struct(F.coalesce(F.concat(F.lit("ROUND-"), anchor), alone).alias("round_id"), alignment.alias("alignment"), anchor.alias("anchor"))


def round_sort_key(anchor: Column, round_id: Column) -> Column:
    """The anchor, else the time in an unaligned round's id; null for unresolved ones,
    which sort last."""
    return F.coalesce(anchor, F.nullif(F.regexp_extract(round_id, r"^ROUND-UNALIGNED::(.*)$", 1), F.lit("")))


def period_id(key: Column, grain: str) -> Column:
    """Day, ISO week (2026-W53) or month of a sort key."""
    day = F.substring(key, 1, 10)
    if grain == "DAILY":
        return day
    if grain == "MONTHLY":
        return F.substring(key, 1, 7)
    d = day.cast("date")
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def expected_rounds(key: Column, grain: str) -> Column:
    per_day = len(ROUND_ANCHORS)
    days = {"DAILY": F.lit(1), "WEEKLY": F.lit(7), "MONTHLY": F.dayofmonth(F.last_day(F.substring(key, 1, 10).cast("date")))}
    return (days[grain] * per_day).cast("long")


def month_id(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_number(name: Column) -> Column:
    """1 to 12 of an English month name; 0 if there is none of that name."""
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(F.trim(name)))


def month_start(year: Column, name: Column) -> Column:
    """First day of a year's month by its English name; null if there is none."""
    return F.make_date(year.cast("int"), F.nullif(month_number(name), F.lit(0)).cast("int"), F.lit(1))


# --- states ------------------------------------------------------------------------
def is_sold_out(status: Column) -> Column:
    return F.lower(F.trim(status)) == "sold out"


def cell_price_state(status: Column, fare: Column) -> Column:
    return F.when((status == "CONSOLIDATED") & fare.isNotNull(), "PRICED").otherwise("NO_PRICE_CELL")


def flight_price_state(fare: Column, sold_out: Column, priced: Column) -> Column:
    """Of a flight's captures without a fare, one that was sold out decides."""
    none = F.coalesce(priced, F.lit(0)) == 0
    return F.when(fare.isNotNull(), "PRICED").when(none & (sold_out > 0), "SOLD_OUT").otherwise("MISSING_PRICE")


def observation_price_state(status: Column, fare: Column) -> Column:
    return F.when(is_sold_out(status), "SOLD_OUT").when(fare.isNotNull(), "PRICED").otherwise("MISSING_PRICE")


def decomposition(base: Column, taxes: Column, fees: Column, total: Column) -> Column:
    """struct(state, reconciles): reconciles is null unless all parts are there."""
    there = base.isNotNull() & taxes.isNotNull() & fees.isNotNull() & total.isNotNull()
    ok = F.abs(total - (base + taxes + fees)) <= COMPONENT_TOLERANCE
    return F.struct(F.when(there, "COMPLETE").otherwise("INCOMPLETE").alias("state"), F.when(there, ok).alias("reconciles"))


def source_coverage(n: Column) -> Column:
    return F.when(n <= 0, "NO_SOURCE").when(n == 1, "SINGLE_SOURCE").when(n < len(EXPECTED_SOURCES), "PARTIAL").otherwise("FULL")


def legacy_fees(aggregate: Column, parts: list[Column]) -> Column:
    """struct(fees, basis): the disclosed aggregate, else the sum of the parts where all
    are disclosed."""
    total = reduce(lambda a, b: a + b, parts)
    basis = F.when(aggregate.isNotNull(), "SOURCE_AGGREGATE").when(total.isNotNull(), "SUM_OF_DISCLOSED_COMPONENTS").otherwise("NOT_DERIVED_UNDISCLOSED_COMPONENTS")
    return F.struct(F.coalesce(aggregate, total).alias("fees"), basis.alias("basis"))


def retry(status: Column, attempt: Column, blocked: Column, retry_after: Column) -> Column:
    """struct(outcome, wait_seconds) of a request: at most three attempts.  Too many
    requests (429) are only retried where the answer says after how many seconds."""
    wait = F.coalesce(retry_after, F.when(attempt == 1, 30).when(attempt == 2, 120))
    again = F.coalesce(status.isin(*RETRIED), F.lit(False)) | ((status == 429) & retry_after.isNotNull())
    out = lambda name, seconds: F.struct(F.lit(name).alias("outcome"), seconds.cast("int").alias("wait_seconds"))
    return (
        F.when(blocked, out("COMPLIANCE_BLOCK", F.lit(0)))
        .when(status.between(200, 299), out("SUCCESS", F.lit(0)))
        .when(again & (attempt < MOST_ATTEMPTS), out("RETRYABLE", wait))
        .otherwise(out("PERMANENT_FAILURE", F.lit(0)))
    )


def fare_class_of(raw: Column, mappings: dict[str, str], known: tuple[str, ...]) -> Column:
    """struct(value, action, is_known): a source's name of a class, mapped exactly."""
    table = F.create_map(*[F.lit(x) for kv in mappings.items() for x in kv])
    value = F.element_at(table, F.trim(raw))
    good = F.coalesce(value.isin(*known), F.lit(False))
    return F.struct(F.when(good, value).otherwise(F.coalesce(F.trim(raw), F.lit(""))).alias("value"), F.when(good, "MAPPED").otherwise("UNKNOWN_FARE_CLASS").alias("action"), good.alias("is_known"))


def unit_price(amount: Column, unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRICE_UNITS.items() for x in kv])
    return (amount.cast("double") / F.element_at(table, unit)).cast("decimal(18,2)")


# --- identity ------------------------------------------------------------------------
def route_id(a: Column, b: Column) -> Column:
    """Undirected: the codes in order; null where one is blank or both are equal."""
    x, y = blank_to_null(airport(a)), blank_to_null(airport(b))
    return F.when(x != y, F.concat_ws("-", F.least(x, y), F.greatest(x, y)))


def checked_route_id(c: Column) -> Column:
    """A route parameter AAA-BBB in canonical order; any other text raises."""
    tidy = F.upper(F.trim(c))
    a, b = F.substring(tidy, 1, 3), F.substring(tidy, 5, 3)
    return F.when(tidy.rlike(r"^[A-Z]{3}-[A-Z]{3}$") & (a != b), route_id(a, b)).otherwise(F.raise_error(F.concat(F.lit("not a route: "), c)).cast("string"))


def directed_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("-", a, b)


def direction_relation(pair: Column, basket_route: Column) -> Column:
    return F.when(basket_route.isNull(), "OFF_BASKET").when(pair == basket_route, "EXACT_KEY_MATCH").otherwise("CANONICALIZED_FROM_REVERSE")


def key(prefix: str, *parts: Column) -> Column:
    """An id of prefix and parts, blank parts marked."""
    return F.concat(F.lit(prefix), F.concat_ws("|", *[F.when(is_missing(p.cast("string")), MISSING_MARKER).otherwise(F.trim(p.cast("string"))) for p in parts]))


def capture_signature(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)


def stable_id(namespace: str, **parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts as compact JSON, keys sorted."""
    body = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]))
    return F.substring(F.sha2(F.concat(F.lit(namespace + ":"), body), 256), 1, 32)


def packed(c: Column, separator: str = ";") -> Column:
    """A set as text: distinct, sorted, joined."""
    return F.array_join(F.array_sort(F.array_distinct(c)), separator)


def packed_map(c: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def unpacked(c: Column, separator: str = ";") -> Column:
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def _bound(c: Column, body) -> Column:
    """``body`` of a value that is worked out once: what stands in several places of an
    expression with lambdas is else worked out anew in each, and for each member."""
    return F.transform(F.array(c), body)[0]


def unpacked_map(c: Column) -> Column:
    """A map of text to money from a=1;b=2; members that do not parse are left out, and
    of members with one name the last counts."""
    cut = F.transform(unpacked(F.coalesce(c, F.lit(""))), lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^=]*)=", 1)).alias("name"), F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("fare")))
    pair = F.transform(cut, lambda p: F.struct(p["name"].alias("name"), money(p["fare"]).alias("fare")))
    good = F.filter(pair, lambda p: p["fare"].isNotNull())
    fare = lambda g, n: F.element_at(F.filter(g, lambda p: p["name"] == n), -1)["fare"]
    of = lambda g: lambda names: F.map_from_arrays(names, F.transform(names, lambda n: fare(g, n)))
    return _bound(good, lambda g: _bound(F.array_distinct(F.transform(g, lambda p: p["name"])), of(g)))


def search_problem(origin: Column, destination: Column, travel: Column, collection: Column) -> Column:
    """Why a live search may not run; null if it may.  A collection day may be absent."""
    a, b = F.upper(F.trim(origin)), F.upper(F.trim(destination))
    no_code = lambda x: ~F.coalesce(x.rlike("^[A-Z]{3}$"), F.lit(False))
    return (
        F.when(no_code(a), "INVALID_ORIGIN")
        .when(no_code(b), "INVALID_DESTINATION")
        .when(a == b, "ORIGIN_EQUALS_DESTINATION")
        .when(travel < collection, "TRAVEL_BEFORE_COLLECTION")
    )


def redacted(c: Column) -> Column:
    """A string map without the values of secret-looking keys."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).rlike("key|token|secret|password|authorization"), F.lit("[REDACTED]")).otherwise(v))


# --- severity ---------------------------------------------------------------------------
def rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def severity(r: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), r + 1)


def ladder(movement: Column, review: float, high: float) -> Column:
    """Rank of an absolute movement: HIGH and REVIEW above their limits, else NONE."""
    return F.when(movement > high, 3).when(movement > review, 2).otherwise(0)


def downgrade(r: Column) -> Column:
    """One rung down, INFO at least; never erases a flag."""
    return F.when(r >= 2, F.greatest(r - 1, F.lit(1))).otherwise(r)


def capped(r: Column, ceiling: Column) -> Column:
    """A rank that never exceeds the ceiling's."""
    return F.least(r, ceiling)


def market_class(sources: Column, flights: Column) -> Column:
    return F.when((sources >= 2) & (flights >= 2), "COHERENT").otherwise("ISOLATED")
