"""Sharding by balanced label propagation, on DataFrame functions alone.

Documents of equal text are one unit, weighing as many rows.  Units are linked through
hubs: a unit has a few hubs (least hashes of its sentences, so near copies share some),
and a hub stands for links among all units that have it, without a row for any pair.

1. A unit heavier than a shard fills whole shards by itself; what is left of it goes on.
2. Labels begin by a hub that is shared but not heavy, and are improved in rounds.  In
   one, a hub counts its rows by shard, its units receive the counts less their own as
   votes, and a unit wants to the shard with most votes.  From a shard to another go as
   many rows as come back, and a share of the room that is left there: candidates are
   counted by gain and hash, and whole classes are let through while their rows fit.
   A random half of the units may move in a round, so that two do not swap for ever.
3. Units without shared hubs fill what room the shards have.
4. All rows then stand in a line, by label, and the line is cut at exact multiples of a
   shard.  Units that no link binds stand at both ends of a label, so a cut falls
   among these; at worst each of the cuts parts one unit.

Counts of rows by shard, class and bucket are bounded tables; they are the only ones
broadcast, with the groups that ``common.met`` proves few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: Hubs a text, rounds of propagation, classes of gain, and hash buckets in each.
HUBS, ROUNDS, GAINS, BUCKETS = 4, 5, 8, 64
#: Buckets of a label's line, and rows of a unit that are numbered together.
LINE, ROWS = 4096, 8192
#: A sentence shorter than this links nothing; votes are counted in millionths.
LEAST_SENTENCE, UNIT = 20, 1_000_000
_BEFORE = (Window.unboundedPreceding, -1)


def sentence_hubs(text: Column, hubs: int = HUBS) -> list[Column]:
    """The least hash of a text's sentences under each of a few hash functions; nulls
    where it has no sentence of some length."""
    sentences = F.filter(F.split(text, r"[.!?\n]+"), lambda s: F.length(s) >= LEAST_SENTENCE)
    hashes = F.transform(sentences, lambda s: F.xxhash64(F.trim(s)))
    return [F.array_min(F.transform(hashes, lambda h, k=k: F.xxhash64(h, F.lit(k)))) for k in range(hubs)]


def _class(unit: str, many: int, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(unit, F.lit(salt)), F.lit(many)).cast("int")


def votes(links: DataFrame, labels: DataFrame, labelled: range) -> DataFrame:
    """(unit, hub, n), (unit, label): per linked unit its n, label, and v0, v1, ...: for
    each shard of ``labelled`` the part of its hubs' other rows there, in millionths."""
    at = common.materialize(links.select("unit", "hub", "n").join(labels.select("unit", "label"), "unit"), "placed")
    counts = [F.sum(F.when(F.col("label") == s, F.col("n")).otherwise(0)).alias(f"t{s}") for s in labelled]
    tally = common.materialize(at.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("rows"), *counts), "tally")
    back = common.met(at, tally, "hub", "members", at.count())
    others = lambda s: F.col(f"t{s}") - F.when(F.col("label") == s, F.col("n")).otherwise(0)
    part = {f"v{s}": F.when(F.col("rows") > F.col("n"), F.floor(UNIT * others(s) / (F.col("rows") - F.col("n")))).otherwise(0) for s in labelled}
    return back.select("unit", "n", "label", *[x.alias(k) for k, x in part.items()]).groupBy("unit").agg(F.max("n").alias("n"), F.max("label").alias("label"), *[F.sum(k).alias(k) for k in part])


def _movers(voted: DataFrame, labelled: range, turn: int) -> DataFrame:
    """Units of this turn that have more votes elsewhere: from, to, and their class."""
    choice = F.array_max(F.array(*[F.struct(F.col(f"v{s}").alias("v"), (F.col("label") == s).alias("stay"), F.lit(-s).alias("s")) for s in labelled]))
    now = reduce(lambda rest, s: F.when(F.col("label") == s, F.col(f"v{s}")).otherwise(rest), labelled, F.lit(0).cast("long"))
    out = voted.where(_class("unit", 2, turn + 1) == 0).withColumn("best", choice).withColumn("gain", F.col("best.v") - now)
    out = out.where("gain > 0").withColumn("level", F.least(F.lit(GAINS - 1), F.col("gain") * GAINS / (HUBS * UNIT)).cast("int"))
    return out.select("unit", "n", F.col("label").alias("from"), (-F.col("best.s")).alias("to"), "level", _class("unit", BUCKETS).alias("bucket"))


def admitted(movers: DataFrame, loads: DataFrame, room: int) -> DataFrame:
    """The classes (from, to, level, bucket) that may move: the largest gains first, while
    their rows stay within what comes the other way and a share of the room there."""
    classes = movers.groupBy("from", "to", "level", "bucket").agg(F.sum("n").alias("n"))
    want = classes.groupBy("from", "to").agg(F.sum("n").alias("want"))
    back = want.select(F.col("to").alias("from"), F.col("from").alias("to"), F.col("want").alias("back"))
    free = loads.select(F.col("label").alias("to"), F.greatest(F.lit(0), F.lit(room) - F.col("load")).alias("free"))
    quota = want.join(F.broadcast(back), ["from", "to"], "left").join(F.broadcast(free), "to", "left")
    share = F.floor(F.coalesce("free", F.lit(room)) * F.col("want") / F.sum("want").over(Window.partitionBy("to")))
    quota = quota.select("from", "to", (F.least("want", F.coalesce("back", F.lit(0))) + share).alias("quota"))
    line = Window.partitionBy("from", "to").orderBy(F.desc("level"), "bucket").rowsBetween(Window.unboundedPreceding, 0)
    return classes.withColumn("through", F.sum("n").over(line)).join(F.broadcast(quota), ["from", "to"]).where("through <= quota").select("from", "to", "level", "bucket")


def propagated(links: DataFrame, labels: DataFrame, labelled: range, room: int, rounds: int = ROUNDS) -> DataFrame:
    """(unit, hub, n), (unit, n, label) -> labels after some rounds of moves."""
    for turn in range(rounds):
        movers = common.materialize(_movers(votes(links, labels, labelled), labelled, turn), "movers")
        if movers.isEmpty():
            break
        loads = labels.groupBy("label").agg(F.sum("n").alias("load"))
        # At most shards squared times classes and buckets: 32,768 rows with 8 shards.
        moved = movers.join(F.broadcast(admitted(movers, loads, room)), ["from", "to", "level", "bucket"]).select("unit", "to")
        labels = common.materialize(labels.join(moved, "unit", "left").select("unit", "n", F.coalesce("to", "label").alias("label")), "labels")
    return labels


def filled(units: DataFrame, loads: DataFrame, labelled: range, room: int) -> DataFrame:
    """(unit, n) without links -> unit, n, label: buckets of units, in order, go to the
    shards in proportion to the room that these have left."""
    buckets = units.withColumn("bucket", _class("unit", LINE)).groupBy("bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(*_BEFORE)
    whole = Window.partitionBy(F.lit(0))
    buckets = buckets.select("bucket", ((F.coalesce(F.sum("n").over(order), F.lit(0)) + F.col("n") / 2) / F.sum("n").over(whole)).alias("middle"))
    free = {r.label: r.load for r in loads.collect()}  # a row a shard
    left = [max(0, room - free.get(s, 0)) for s in labelled]
    left = left if sum(left) else [1] * len(left)
    ends = [sum(left[: k + 1]) / sum(left) for k in range(len(left))]
    label = reduce(lambda rest, k: F.when(F.col("middle") < ends[k], F.lit(labelled[k])).otherwise(rest), reversed(range(len(ends) - 1)), F.lit(labelled[max(k for k in range(len(left)) if left[k])]))
    return units.withColumn("bucket", _class("unit", LINE)).join(F.broadcast(buckets.select("bucket", label.alias("label"))), "bucket").select("unit", "n", "label")


def in_line(units: DataFrame) -> DataFrame:
    """(unit, n, label, zone) with the number of rows before each unit, in the order of
    label, zone, hash bucket and unit: sums of labels' zones, of buckets, then of units."""
    units = units.withColumn("bucket", _class("unit", LINE))
    bucket = units.groupBy("label", "zone", "bucket").agg(F.sum("n").alias("rows"))
    zone = bucket.groupBy("label", "zone").agg(F.sum("rows").alias("rows"))  # three a label
    ahead = lambda over: F.coalesce(F.sum("rows").over(over.rowsBetween(*_BEFORE)), F.lit(0))
    zone = zone.select("label", "zone", ahead(Window.partitionBy(F.lit(0)).orderBy("label", "zone")).alias("zone_start"))
    bucket = bucket.withColumn("bucket_start", ahead(Window.partitionBy("label", "zone").orderBy("bucket"))).drop("rows")
    within = Window.partitionBy("label", "zone", "bucket").orderBy("unit").rowsBetween(*_BEFORE)
    units = units.withColumn("unit_start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return units.join(bucket, ["label", "zone", "bucket"]).join(F.broadcast(zone), ["label", "zone"]).withColumn("start", F.col("zone_start") + F.col("bucket_start") + F.col("unit_start")).select("unit", "start")


def numbered(rows: DataFrame, units: DataFrame, total: int) -> DataFrame:
    """Rows (unit, doc_id, size, crc) with their number within the unit, from 0, and the
    columns of ``units`` (one row a unit, of members rows).  Rows alike are counted, not
    sorted; a unit of many rows is numbered in pieces, by a hash of doc_id."""
    alike = rows.groupBy("unit", "doc_id", "size", "crc").agg(F.count(F.lit(1)).alias("times"))
    pieces = F.ceil(F.col("members") / ROWS)
    alike = common.met(alike, units, "unit", "members", total).withColumn("piece", F.pmod(F.xxhash64("doc_id"), pieces))
    within = Window.partitionBy("unit", "piece").orderBy("doc_id").rowsBetween(*_BEFORE)
    alike = alike.withColumn("before", F.coalesce(F.sum("times").over(within), F.lit(0)))
    many = F.col("members") > ROWS
    sums = alike.where(many).groupBy("unit", "piece").agg(F.sum("times").alias("rows"))
    ahead = F.coalesce(F.sum("rows").over(Window.partitionBy("unit").orderBy("piece").rowsBetween(*_BEFORE)), F.lit(0))
    sums = sums.select("unit", "piece", ahead.alias("ahead"))
    parts = alike.where(many).join(sums.hint("merge"), ["unit", "piece"]).withColumn("before", F.col("before") + F.col("ahead")).drop("ahead")
    out = common.repeated(alike.where(~many).unionByName(parts), "times", "nth")
    return out.withColumn("number", F.col("before") + F.col("nth") - 1)


def sharded(docs: DataFrame, shards: int = SHARDS, hubs=sentence_hubs, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text) -> doc_id, size, crc, shard, slot.

    Shards hold numbers of rows at most one apart; slots count from 0 within a shard.
    ``hubs``: from a text column to the columns of its hubs, nulls where it has none.
    Equal texts, null and empty ones being equal, share a shard unless they are more than
    one holds or a cut of the line falls among them, which it does at most once a shard.
    Null and repeated ids stay; rows alike are interchangeable.  The result depends on
    the rows alone, not on their order or partitions.  Other columns are not read, and an
    empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    links = [h.alias(f"h{k}") for k, h in enumerate(hubs(text))]
    names = [f"h{k}" for k in range(len(links))]
    rows = common.materialize(docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("unit"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("crc"), *links), "rows")
    units = common.materialize(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("members"), *[F.max(h).alias(h) for h in names]), "units")
    total = units.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    room, larger = divmod(total, shards)
    # Shards that one unit fills: at most all of them, so at most as many such units.
    alone = F.floor(F.col("members") / F.greatest(F.lit(room), F.lit(1))) if room else F.lit(0)
    heavy = units.where(alone > 0).select("unit", (alone * room).alias("alone"))
    order = Window.partitionBy(F.lit(0)).orderBy("unit").rowsBetween(*_BEFORE)
    heavy = heavy.withColumn("alone_start", F.coalesce(F.sum("alone").over(order), F.lit(0)))
    taken = heavy.agg(F.coalesce(F.sum("alone"), F.lit(0))).first()[0]
    labelled = range(min(shards - 1, taken // room if room else 0), shards)
    units = units.withColumn("n", F.col("members") - alone * room)

    hub = units.where("n > 0").select("unit", "n", F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("hub"))
    shared = common.materialize(hub.groupBy("hub").agg(F.count(F.lit(1)).alias("linked"), F.sum("n").alias("weight")).where("linked > 1"), "hubs")
    several = shared.agg(F.coalesce(F.sum("linked"), F.lit(0))).first()[0]
    linked = common.materialize(common.met(hub, shared, "hub", "linked", several), "links")
    light = F.min(F.when(F.col("weight") <= room / 16, F.col("hub")))
    begin = lambda x: (F.pmod(F.xxhash64(x), F.lit(len(labelled))) + labelled[0]).cast("int")
    labels = linked.groupBy("unit").agg(F.max("n").alias("n"), light.alias("hub")).select("unit", "n", F.coalesce(F.when(F.col("hub").isNotNull(), begin("hub")), begin("unit")).alias("label"))
    labels = propagated(linked, common.materialize(labels, "labels"), labelled, room, rounds)

    free = units.where("n > 0").select("unit", "n").join(labels.select("unit").hint("merge"), "unit", "left_anti")
    placed = labels.withColumn("zone", F.lit(1))
    for part in (free.where("n > 1"), free.where("n = 1")):
        loads = placed.groupBy("label").agg(F.sum("n").alias("load"))
        zone = F.when(F.col("n") > 1, 1).otherwise(2 * _class("unit", 2))
        placed = common.materialize(placed.unionByName(filled(part, loads, labelled, room).withColumn("zone", zone)), "placed")

    starts = units.select("unit", "members").join(in_line(placed), "unit", "left").join(F.broadcast(heavy), "unit", "left")
    starts = common.materialize(starts.select("unit", "members", F.coalesce("alone", F.lit(0)).alias("alone"), "alone_start", (F.col("start") + taken).alias("start")), "starts")
    out = numbered(rows.select("unit", "doc_id", "size", "crc"), starts, total)
    place = F.when(F.col("number") < F.col("alone"), F.col("alone_start") + F.col("number")).otherwise(F.col("start") + F.col("number") - F.col("alone"))
    out = out.withColumn("place", place)
    edge = (shards - larger) * room  # the last shards hold one more where the rows do not divide
    low = F.floor(F.col("place") / max(room, 1))
    high = F.floor((F.col("place") - edge) / (room + 1))
    small = F.col("place") < edge
    shard = F.when(small, low).otherwise(high + (shards - larger))
    slot = F.when(small, F.col("place") - low * room).otherwise(F.col("place") - edge - high * (room + 1))
    return out.select("doc_id", "size", "crc", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(common.documents(spark, sf_dir))
    return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
