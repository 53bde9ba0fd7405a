"""Collection control: the query matrix, source gates, coverage, quotes and their age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: What a source's registry row must say before it may be queried.
LIVE_MODES = ("AUTHORIZED_API", "AUTHORIZED_WEB_COLLECTION", "PERMITTED_PUBLIC_ENDPOINT")
EVIDENCE = ("API_CONTRACT", "WRITTEN_PERMISSION", "PARTNER_ONBOARDING", "EXPLICITLY_PERMITTED_PUBLIC_ENDPOINT")
TERMS_DAYS = 30
PARTNER_SETTINGS = ("api_key", "authorization_reference", "terms_review_date", "terms_version", "terms_sha256", "retention_hours", "display_authorized")
WINDOW_DAYS = {"T1": 1, "T7": 7, "T15": 15, "T30": 30, "T45": 45}


def query_matrix(basket: DataFrame, sources: DataFrame, collection_date: str, anchors: tuple[str, ...] = S.ROUND_ANCHORS) -> DataFrame:
    """Sources by routes, both directions, windows and anchors: one row a planned query.
    The basket and the registry are small tables."""
    rows = basket.select("route_id").crossJoin(F.broadcast(sources.select("source_id")))
    rows = rows.withColumn("direction", F.explode(F.array(F.lit("OUT"), F.lit("BACK"))))
    rows = rows.withColumn("w", F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.lit(d).alias("days")) for k, d in WINDOW_DAYS.items()])))
    rows = rows.withColumn("anchor", F.explode(F.array(*[F.lit(a) for a in anchors])))
    a, b = F.substring_index("route_id", "-", 1), F.substring_index("route_id", "-", -1)
    day = F.lit(collection_date).cast("date")
    out = rows.select(
        "source_id", "route_id", F.when(F.col("direction") == "OUT", a).otherwise(b).alias("origin"), F.when(F.col("direction") == "OUT", b).otherwise(a).alias("destination"), F.col("w.window").alias("window"),
        F.date_add(day, F.col("w.days")).alias("travel_date"), F.concat(F.lit("ROUND-"), F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.col("anchor")).alias("collection_round_id"),
    )
    return out.withColumn("query_id", S.stable_id("query", **{k: F.col(k).cast("string") for k in ("source_id", "origin", "destination", "window", "travel_date", "collection_round_id")}))


def gate(registry: DataFrame, today: str) -> DataFrame:
    """All reasons why a source may not be queried, in a fixed order: gate_failures and
    may_collect.  Blank and null fail every check but the expiry, which may be open."""
    text = lambda n: F.coalesce(F.trim(F.col(n).cast("string")), F.lit(""))
    day = F.lit(today).cast("date")
    reviewed, expiry = S.date(text("terms_review_date")), S.date(text("authorization_expiry"))
    absent = lambda n: ~text(n).isin("NO", "NOT_APPLICABLE")
    checks = [
        ("COLLECTION_MODE", ~text("collection_mode").isin(*LIVE_MODES)),
        ("AUTHORIZATION_STATUS", text("authorization_status") != "APPROVED"),
        ("AUTHORIZATION_EVIDENCE", ~text("authorization_evidence_type").isin(*EVIDENCE)),
        ("ADAPTER_DISABLED", (text("allowed_automation") != "True") | (text("adapter_status") != "ENABLED")),
        ("TERMS_NOT_APPROVED", text("terms_review_status") != "APPROVED"),
        ("TERMS_DATE_MISSING", text("terms_review_date") == ""),
        ("TERMS_REVIEW_INACTIVE", (text("terms_review_date") != "") & ~F.coalesce(F.datediff(day, reviewed).between(0, TERMS_DAYS), F.lit(False))),
        ("AUTHORIZATION_EXPIRED", (text("authorization_expiry") != "") & F.coalesce(expiry < day, F.lit(True))),
        ("TERMS_HASH_MISSING", text("terms_content_hash") == ""),
        ("CAPTCHA", absent("captcha_present")),
        ("BOT_PROTECTION", absent("bot_protection_present")),
        ("RATE_LIMIT_UNKNOWN", text("rate_limit_policy").isin("", "UNKNOWN")),
        ("MAXIMUM_REQUESTS_MISSING", text("maximum_requests_per_round") == ""),
        ("HEALTH_CHECK", text("source_health_check") != "PASSED"),
        ("DRY_RUN_FEASIBILITY", text("dry_run_schedule_feasibility") != "PASSED"),
    ]
    out = registry.withColumn("gate_failures", F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks])))
    return out.withColumn("may_collect", F.size("gate_failures") == 0)


def partner_gate(settings: DataFrame, today: str) -> DataFrame:
    """Why a partner's live prices may not be queried, the first reason only (null where
    they may): one row a set of settings, all text."""
    text = lambda n: F.coalesce(F.trim(F.col(n)), F.lit(""))
    true = lambda n: F.lower(text(n)).isin("1", "true", "yes", "on")
    reviewed, hours, expiry = S.date(text("terms_review_date")), text("retention_hours").try_cast("int"), text("authorization_expiry")
    age = F.datediff(F.lit(today).cast("date"), reviewed)
    missing = F.array_compact(F.array(*[F.when(text(n) == "", F.lit(n)) for n in PARTNER_SETTINGS]))
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("MISSING: "), F.array_join(missing, ", ")))
        .when(~true("authorized"), "NOT_AUTHORIZED")
        .when(~true("display_authorized"), "DISPLAY_NOT_AUTHORIZED")
        .when(~text("terms_sha256").rlike("^[0-9a-fA-F]{64}$"), "TERMS_HASH_INVALID")
        .when(reviewed.isNull() | hours.isNull(), "TERMS_DATE_OR_RETENTION_INVALID")
        .when(~age.between(0, TERMS_DAYS), "TERMS_REVIEW_INACTIVE")
        .when(hours < 1, "RETENTION_TOO_SHORT")
        .when((expiry != "") & S.date(expiry).isNull(), "EXPIRY_INVALID")
        .when(S.date(expiry) < F.lit(today).cast("date"), "AUTHORIZATION_EXPIRED")
    )
    return settings.withColumn("block_reason", reason)


def checked_registry(registry: DataFrame, source_ids: tuple[str, ...]) -> DataFrame:
    """The registry, once it holds exactly the required sources, each once."""
    found = sorted(r[0] or "" for r in registry.select("source_id").limit(2 * len(source_ids) + 1).collect())
    if found != sorted(source_ids):
        raise ValueError(f"registry: {found} where {sorted(source_ids)} are required")
    return registry


def dry_run(matrix: DataFrame, gated: DataFrame) -> DataFrame:
    """An attempt for each planned query, blocked where the gate is shut."""
    g = gated.select("source_id", "may_collect", F.array_join("gate_failures", ";").alias("block_reason"))
    return matrix.join(F.broadcast(g), "source_id", "left").withColumn("attempt_status", F.when(F.coalesce("may_collect", F.lit(False)), "PLANNED").otherwise("BLOCKED"))


def collection_coverage(attempts: DataFrame, by: str) -> DataFrame:
    """Planned and blocked attempts by source, route or round."""
    blocked = F.count_if(F.col("attempt_status") == "BLOCKED")
    return attempts.groupBy(by).agg(F.count(F.lit(1)).alias("planned"), blocked.alias("blocked"), F.round(100 * (F.count(F.lit(1)) - blocked) / F.count(F.lit(1)), 4).alias("coverage_pct"))


#: What is read of a recorded search payload.
LEG = "struct<flight_number:string,airline:string,departure_airport:struct<id:string,time:string>,arrival_airport:struct<id:string,time:string>,travel_class:string>"
PAYLOAD = f"struct<best_flights:array<struct<price:double,flights:array<{LEG}>>>,other_flights:array<struct<price:double,flights:array<{LEG}>>>,currency:string>"


def flattened(payloads: DataFrame) -> DataFrame:
    """(query_id, collected_at, payload JSON) -> one row an offer: single legs with a
    price above zero, in rupees."""
    p = payloads.withColumn("p", F.from_json("payload", PAYLOAD))
    offers = F.concat(F.coalesce("p.best_flights", F.array().cast(f"array<struct<price:double,flights:array<{LEG}>>>")), F.coalesce("p.other_flights", F.array().cast(f"array<struct<price:double,flights:array<{LEG}>>>")))
    out = p.withColumn("currency", F.coalesce("p.currency", F.lit("INR"))).select("query_id", "collected_at", "currency", F.explode(offers).alias("o"))
    out = out.where((F.col("o.price") > 0) & (F.size("o.flights") == 1) & (F.col("currency") == "INR")).withColumn("leg", F.col("o.flights")[0])
    return out.select("query_id", "collected_at", F.col("leg.departure_airport.id").alias("origin"), F.col("leg.arrival_airport.id").alias("destination"), S.flight_number(F.col("leg.flight_number")).alias("flight_number"), F.col("leg.airline").alias("carrier"), F.regexp_extract("leg.departure_airport.time", r"(\d{2}:\d{2})", 1).alias("departure_time"), F.col("leg.travel_class").alias("fare_class"), S.cents(F.col("o.price")).alias("fare_cents"))


#: Where providers keep what an offer needs: its list, and paths within one of its members.
LAYOUTS = {
    "search": {"offers": "$.best_flights", "price": "$.price", "currency": "$.currency", "origin": "$.flights[0].departure_airport.id", "destination": "$.flights[0].arrival_airport.id", "flight_number": "$.flights[0].flight_number", "fare_class": "$.flights[0].travel_class"},
    "partner": {"offers": "$.content.results", "price": "$.pricing.total", "currency": "$.pricing.unit", "origin": "$.leg.from", "destination": "$.leg.to", "flight_number": "$.leg.number", "fare_class": "$.cabin"},
}
_OFFER = {"price": "decimal(18,2)", "currency": "string", "origin": "string", "destination": "string", "flight_number": "string", "fare_class": "string"}


def provider_offers(payloads: DataFrame, layouts: dict[str, dict[str, str]] = LAYOUTS) -> DataFrame:
    """(query_id, provider, collected_at, payload JSON) -> one row an offer, whatever the
    shape of a provider's payload: only the paths of ``layouts`` are read.

    ``offers`` may lead to a list or to an object of offers; position is the offer's index
    or name.  A payload that is no JSON, has no offers or is of an unknown provider has no
    row; a field that is absent or of the wrong kind is null.  Offers without a price
    above zero are left out.
    """
    by = lambda field, make: F.coalesce(*[F.when(F.col("provider") == p, make(x[field])) for p, x in layouts.items() if field in x])
    parsed = payloads.select("query_id", "provider", "collected_at", F.try_parse_json("payload").alias("p"))
    listed = parsed.withColumn("offers", by("offers", lambda path: F.try_variant_get("p", path, "variant"))).where(F.col("offers").isNotNull()).drop("p")
    each = listed.lateralJoin(listed.sparkSession.tvf.variant_explode(F.col("offers").outer()))
    position = F.coalesce("key", F.col("pos").cast("string"))
    fields = {name: by(name, lambda path, kind=kind: F.try_variant_get("value", path, kind)).alias(name) for name, kind in _OFFER.items()}
    return each.select("query_id", "provider", "collected_at", position.alias("position"), *fields.values()).where("price > 0")


def fresh(quotes: DataFrame, now: str, hours: int = 2, at: str = "collected_at") -> DataFrame:
    """Quotes younger than their time to live."""
    return quotes.where(F.col(at) > F.expr(f"timestamp_ntz'{now}' - make_interval(0, 0, 0, 0, {int(hours)}, 0, 0)"))


def expiries(quotes: DataFrame, now, hours: int = 2, query_id: str = "query_id", at: str = "collected_at") -> DataFrame:
    """(query_id, collected_at, expired_at) of the quotes whose time to live has ended at
    ``now`` without a newer capture of the same query within it."""
    end = F.col(at) + F.expr(f"make_interval(0, 0, 0, 0, {int(hours)}, 0, 0)")
    seen = quotes.where(F.col(at).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).cast("string").alias("query_id"), F.col(at).alias("collected_at"), end.alias("expired_at")).distinct()
    later = F.lead("collected_at").over(Window.partitionBy("query_id").orderBy("collected_at"))
    return seen.withColumn("_later", later).where((F.col("expired_at") <= now) & ~F.coalesce(F.col("_later") < F.col("expired_at"), F.lit(False))).drop("_later")


def readiness(runs: DataFrame, now: str, hours: int = 2) -> DataFrame:
    """Per source: its last complete run, until when that is fresh, and whether it is."""
    done = runs.where("run_status in ('COMPLETE', 'PARTIAL')").groupBy("source_id").agg(F.max("completed_at").alias("completed_at"))
    until = F.col("completed_at") + F.expr(f"make_interval(0, 0, 0, 0, {int(hours)}, 0, 0)")
    return done.withColumn("fresh_until", until).withColumn("ready", until > F.expr(f"timestamp_ntz'{now}'"))


def run_status(attempts: DataFrame) -> DataFrame:
    """COMPLETE, PARTIAL, FAILED or DENIED of each run, from its attempts' outcomes."""
    ok, n = F.count_if(F.col("outcome") == "SUCCESS"), F.count(F.lit(1))
    denied = F.count_if(F.col("outcome") == "DENIED")
    return attempts.groupBy("run_id").agg(n.alias("attempts"), ok.alias("successes"), F.when(denied > 0, "DENIED").when(ok == n, "COMPLETE").when(ok > 0, "PARTIAL").otherwise("FAILED").alias("run_status"))


def planned_searches(basket: DataFrame, collection_date: str, selected: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of the basket's routes, or of those selected (in either order), by
    window.  A selected route that the basket lacks is an error."""
    wanted = {"-".join(sorted(p.strip().upper() for p in r.split("-", 1))) for r in selected}
    rows = basket.select("route_id", "basket_rank")
    if wanted:
        rows = rows.where(F.col("route_id").isin(*wanted))
        lost = wanted - {r.route_id for r in rows.limit(len(wanted)).collect()}
        if lost:
            raise ValueError(f"unknown basket routes: {sorted(lost)}")
    a, b = F.substring_index("route_id", "-", 1), F.substring_index("route_id", "-", -1)
    way = F.explode(F.array(F.struct(a.alias("origin"), b.alias("destination")), F.struct(b.alias("origin"), a.alias("destination"))))
    named = [F.struct(F.lit(k).alias("code"), F.lit(d).alias("days")) for k, d in WINDOW_DAYS.items()]
    rows = rows.withColumn("way", way).withColumn("w", F.explode(F.array(*named)))
    day = F.lit(collection_date).cast("date")
    return rows.select("route_id", "basket_rank", "way.origin", "way.destination", day.alias("collection_date"), F.date_add(day, F.col("w.days")).alias("travel_date"), F.col("w.days").alias("advance_purchase_days"), F.col("w.code").alias("apw_target_code"))


#: What is read of a payload whose itineraries, legs, segments, carriers and agents are
#: maps by id.
_TIME = "struct<year:string,month:string,day:string,hour:string,minute:string,second:string>"
_PRICE = "struct<amount:string,unit:string>"
_OPTION = f"struct<id:string,agentIds:array<string>,price:{_PRICE},pricingOptionFare:struct<brandNames:array<string>>,items:array<struct<agentId:string,price:{_PRICE}>>>"
_RESULTS = (
    f"struct<itineraries:map<string,struct<legIds:array<string>,pricingOptions:array<{_OPTION}>>>,legs:map<string,struct<stopCount:string,segmentIds:array<string>,marketingCarrierIds:array<string>>>,"
    f"segments:map<string,struct<marketingCarrierId:string,marketingFlightNumber:string,departureDateTime:{_TIME},arrivalDateTime:{_TIME}>>,carriers:map<string,struct<iata:string,name:string>>,agents:map<string,struct<name:string>>>"
)
UNCLASSIFIED = "ECONOMY_UNCLASSIFIED"


def _iso(t) -> F.Column:
    """A struct of parts as ISO text; null where these are no time."""
    part = lambda n: t[n].try_cast("int")
    rest = [F.coalesce(part(n), F.lit(0)) for n in ("hour", "minute", "second")]
    return F.date_format(F.try_make_timestamp_ntz(part("year"), part("month"), part("day"), *rest), "yyyy-MM-dd'T'HH:mm:ss")


def itinerary_offers(payloads: DataFrame, mappings: dict[str, str], known: tuple[str, ...]) -> DataFrame:
    """(query_id, collected_at, payload JSON) -> one row an item of a pricing option of a
    direct, single-leg itinerary, with its segment, carrier and agent looked up by id.
    Items without a price above zero are left out; ids that lead nowhere give nulls."""
    c, get = F.col, F.get
    p = payloads.select("query_id", "collected_at", F.from_json("payload", f"struct<content:struct<results:{_RESULTS}>>")["content"]["results"].alias("r"))
    out = p.select("*", F.explode(F.map_entries("r.itineraries")).alias("i")).where(F.size("i.value.legIds") == 1)
    out = out.withColumn("leg", F.element_at("r.legs", get("i.value.legIds", F.lit(0)))).where(c("leg.stopCount").try_cast("int") == 0)
    out = out.withColumn("segment", F.element_at("r.segments", get("leg.segmentIds", F.lit(0))))
    carrier = F.coalesce(F.nullif(c("segment.marketingCarrierId"), F.lit("")), get("leg.marketingCarrierIds", F.lit(0)))
    out = out.withColumn("carrier", F.element_at("r.carriers", carrier))
    out = out.select("query_id", "collected_at", c("i.key").alias("itinerary_id"), "segment", "carrier", c("r.agents").alias("agents"), F.explode("i.value.pricingOptions").alias("o"))
    whole = F.array(F.struct(get("o.agentIds", F.lit(0)).alias("agentId"), c("o.price").alias("price")))
    out = out.withColumn("item", F.explode(F.when(F.size("o.items") > 0, c("o.items")).otherwise(whole)))
    price = F.coalesce("item.price", "o.price")
    out = out.withColumns({"unit": price["unit"], "total_fare": S.unit_price(price["amount"].try_cast("double"), price["unit"]), "agent_id": F.coalesce("item.agentId", get("o.agentIds", F.lit(0)))}).where("total_fare > 0")
    brands = F.array_join("o.pricingOptionFare.brandNames", " | ")
    out = out.withColumn("fare_class_raw", F.coalesce(F.nullif(brands, F.lit("")), F.lit(UNCLASSIFIED)))
    fare = S.fare_class_of(c("fare_class_raw"), mappings, known)
    return out.select(
        "query_id", "collected_at", "itinerary_id", c("o.id").alias("pricing_option_id"), "agent_id", F.element_at("agents", c("agent_id"))["name"].alias("agent"), "total_fare", c("unit").alias("price_unit"),
        "fare_class_raw", fare["value"].alias("fare_class"), fare["action"].alias("fare_class_action"), c("carrier.iata").alias("carrier_code"), c("carrier.name").alias("carrier"), c("segment.marketingFlightNumber").alias("flight_number"),
        _iso(c("segment.departureDateTime")).alias("departure_at"), _iso(c("segment.arrivalDateTime")).alias("arrival_at"),
    )
