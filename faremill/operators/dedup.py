"""Technical duplicates: an anchored sweep of captures within a tolerance.

Rows of one bucket (product instance, source, fare or sold out) in time order join the
open group while they are within the tolerance of its first row, the anchor.  A bucket
may hold a third of all rows, so its line is never in one task:

1. Rows of one bucket and time are one node; it carries their number and least id.
2. The line is cut into blocks of some hundred tolerances.  A block also gets the nodes
   shortly before it, as many as the rules look back, and windows run within a block.  A
   node after a gap wider than the tolerance opens a group; nodes within the tolerance
   of it are settled; so are those within the tolerance of the first one left over.
3. What is then left, the later nodes of long stretches, follows pointers: a node's
   next anchor is the first one beyond its tolerance.  Each block finds, by pointer
   doubling, where a path that enters it leaves it; paths are followed from block to
   block (a few rows a block); and each block marks the anchors on its paths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

IDENTITY = ("origin", "destination", "carrier", "flight_number", "travel_date", "departure_time", "fare_class", "source")
#: Tolerances a block, and those that a block looks back.  The first node that it sees
#: passes for one after a gap; that error ends within two tolerances in each of the two
#: rounds of settling, and the first node is within one of where the block looks back to.
BLOCK, BACK = 256, 6


def anchored_sweep(rows: DataFrame, bucket: list[str], ts: str, order: str, tolerance_minutes: int = S.DUPLICATE_TOLERANCE_MINUTES) -> DataFrame:
    """Adds canonical (the ``order`` value of the group's anchor) and group_size.  No
    task holds more of a bucket than a block's times, or its paths' few rows a block.  A
    row without a time is its own anchor."""
    seconds = tolerance_minutes * 60
    rows = rows.withColumns({"_t": F.unix_seconds(F.col(ts).cast("timestamp")), "_bucket": F.to_json(F.struct(*bucket))})
    nodes = rows.where("_t is not null").groupBy("_bucket", "_t").agg(F.min(order).alias("_id"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_bucket", "canonical")
    placed = _placed(nodes, seconds).withColumn("group_size", F.sum("_n").over(own)).drop("_n")
    alone = rows.where("_t is null").withColumns({"canonical": F.col(order), "group_size": F.lit(1).cast("long")})
    return rows.join(placed, ["_bucket", "_t"]).unionByName(alone).drop("_t", "_bucket")


def _placed(nodes: DataFrame, seconds: int) -> DataFrame:
    """(_bucket, _t, _id, _n) -> _bucket, _t, _n, canonical."""
    span = BLOCK * seconds
    block = F.floor(F.col("_t") / span).cast("long")
    before = F.when(F.col("_t") >= (block + 1) * span - BACK * seconds, block + 1)  # the block after looks back
    copies = nodes.withColumn("_block", F.explode(F.array_compact(F.array(block, before))))
    line = Window.partitionBy("_bucket", "_block").orderBy("_t")
    reach = line.rowsBetween(Window.unboundedPreceding, 0)
    node = F.struct(F.col("_t").alias("t"), F.col("_id").alias("id"))
    late = lambda c: F.coalesce(F.col("_t") - F.col(f"{c}.t") > seconds, F.lit(True))
    step = copies.withColumn("_gap", F.coalesce(F.col("_t") - F.lag("_t").over(line) > seconds, F.lit(True)))
    step = step.withColumn("_open", F.last(F.when(F.col("_gap"), node), ignorenulls=True).over(reach)).withColumn("_late", late("_open"))
    for _ in range(2):  # the first late node of a stretch is the next anchor after the open one
        step = step.withColumn("_first", F.col("_late") & ~F.coalesce(F.lag("_late").over(line), F.lit(False)))
        step = step.withColumn("_next", F.last(F.when(F.col("_first"), node), ignorenulls=True).over(reach))
        step = step.withColumn("_open", F.when(F.col("_late"), F.col("_next")).otherwise(F.col("_open"))).withColumn("_late", late("_open"))
    # Of what is left, the first node of a stretch is an anchor whatever comes before.
    step = step.withColumn("_root", F.col("_late") & ~F.coalesce(F.lag("_late").over(line), F.lit(False))).where(F.col("_block") == block)
    near = step.where(~F.col("_late")).select("_bucket", "_t", "_n", F.col("_open.id").alias("canonical"))
    far = step.where("_late").select("_bucket", "_block", "_t", "_id", "_n", "_root")
    return near.unionByName(_followed(far, seconds, span))


def _pointers(t: np.ndarray, seconds: int) -> np.ndarray:
    """For each of the sorted times the place of its next anchor, or -1 at a stretch's end:
    within a stretch no gap is wider than the tolerance."""
    after = np.searchsorted(t, t + seconds, side="right")
    there = np.append(t, np.iinfo(np.int64).max)[after] <= t + 2 * seconds
    return np.where(there, after, -1)


def _followed(far: DataFrame, seconds: int, span: int) -> DataFrame:
    """(_bucket, _block, _t, _id, _n, _root) -> _bucket, _t, _n, canonical."""
    kind = far.schema["_id"].dataType.simpleString()

    def exits(table: pa.Table) -> pa.Table:
        """Of a block's roots and of nodes where a path may enter it: the last anchor in
        the block, and the first one after it."""
        table = table.sort_by("_t")
        t, mine = table["_t"].to_numpy(), table["_own"].to_numpy(zero_copy_only=False)
        to = _pointers(t, seconds)
        inside = (to >= 0) & mine[to]
        last = np.where(inside, to, np.arange(len(t)))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        start = table["_block"][0].as_py() * span
        at = np.flatnonzero(mine & (table["_root"].to_numpy(zero_copy_only=False) | (t < start + 2 * seconds)))
        out = to[last[at]]
        return pa.table({"_bucket": table["_bucket"].take(pa.array(at)), "src": pa.array(t[at]), "last": pa.array(t[last[at]]), "last_id": table["_id"].take(pa.array(last[at])), "dst": pa.array(t[out], mask=out < 0), "root": table["_root"].take(pa.array(at))})

    def paths(table: pa.Table) -> pa.Table:
        """Entries of blocks that a bucket's roots lead to, with the anchor before."""
        table = table.sort_by("src")
        src, on = table["src"].to_numpy(), table["root"].to_numpy(zero_copy_only=False).copy()
        dst = table["dst"].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        ends = table["dst"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        front = np.flatnonzero(on & ~ends)
        while len(front):
            reached = np.unique(np.searchsorted(src, dst[front]))
            reached = reached[~on[reached]]
            on[reached] = True
            front = reached[~ends[reached]]
        at = pa.array(np.flatnonzero(on))
        last = table["last"].take(at).to_numpy()
        return pa.table({"_bucket": table["_bucket"].take(at), "_block": pa.array(last // span + 1), "open": table["last"].take(at), "open_id": table["last_id"].take(at), "entry": table["dst"].take(at)})

    def marked(table: pa.Table) -> pa.Table:
        """Every node of a block with its anchor's id."""
        table = table.sort_by("_t")
        t, on = table["_t"].to_numpy(), table["_root"].to_numpy(zero_copy_only=False).copy()
        entry = table["entry"][0].as_py()
        if entry is not None:
            on[np.searchsorted(t, entry)] = True
        to, front = _pointers(t, seconds), np.flatnonzero(on)
        while len(front):
            front = to[front]
            front = front[front >= 0]
            front = np.unique(front[~on[front]])
            on[front] = True
        anchors = np.flatnonzero(on)
        place = np.searchsorted(t[anchors], t, side="right") - 1
        held = place >= 0
        held[held] = t[held] - t[anchors[place[held]]] <= seconds
        ids = pa.chunked_array([*table["_id"].chunks, *table["open_id"].slice(0, 1).chunks])
        chosen = np.full(len(t), len(t))
        chosen[held] = anchors[place[held]]
        return pa.table({"_bucket": table["_bucket"], "_t": table["_t"], "_n": table["_n"], "canonical": ids.take(pa.array(chosen))})

    shared = F.when(F.col("_t") < F.col("_block") * span + 2 * seconds, F.struct((F.col("_block") - 1).alias("b"), F.lit(False).alias("own")))
    both = F.explode(F.array_compact(F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own")), shared)))
    seen = far.withColumn("_c", both).select("_bucket", F.col("_c.b").alias("_block"), "_t", "_id", "_root", F.col("_c.own").alias("_own"))
    # A block with nothing of its own is the one before a block, and has no exits.
    leads = seen.groupBy("_bucket", "_block").applyInArrow(exits, f"_bucket string, src long, last long, last_id {kind}, dst long, root boolean")
    crossed = leads.groupBy("_bucket").applyInArrow(paths, f"_bucket string, _block long, open long, open_id {kind}, entry long")
    crossed = crossed.groupBy("_bucket", "_block").agg(F.max_by("open_id", "open").alias("open_id"), F.max("entry").alias("entry"))
    held = far.join(crossed, ["_bucket", "_block"], "left")
    return held.groupBy("_bucket", "_block").applyInArrow(marked, f"_bucket string, _t long, _n long, canonical {kind}")


def _time(rows: DataFrame):
    """The capture time, typed or text."""
    c = F.col("collection_timestamp")
    return c.cast("timestamp_ntz") if dict(rows.dtypes)["collection_timestamp"].startswith("timestamp") else S.timestamp(c)


def deduplicate(validated: DataFrame) -> DataFrame:
    """Adds duplicate_group_id, is_duplicate, duplicate_of, duplicate_reason, retained
    and capture_signature_agreement to every row; rows carry a unique observation_id.
    The rows are persisted; a session that goes on to others clears its cache."""
    c = F.col
    rows = validated.withColumn("_missing", F.array_compact(F.array(*[F.when(S.is_missing(c(n).cast("string")), F.lit(n)) for n in IDENTITY])))
    rows = rows.withColumn("_fare", S.fare_text(c("total_fare").cast("string"))).withColumn("_ts", _time(validated))
    # Read several times below; kept, so that the rules behind is_valid run once.
    rows = rows.withColumn("_price", F.when(c("availability_status") == "Sold Out", "SOLD_OUT").otherwise(c("_fare"))).persist()
    fit = c("is_valid") & (F.size("_missing") == 0) & c("_price").isNotNull()
    bucket = [*IDENTITY, "_price"]
    timed = rows.where(fit & c("_ts").isNotNull())
    swept = anchored_sweep(timed.select("observation_id", "_ts", *bucket), bucket, "_ts", "observation_id").select("observation_id", "canonical", "group_size")
    out = rows.join(swept, "observation_id", "left")
    seen = timed.select(*[c(b).alias(f"_s_{b}") for b in bucket]).distinct().withColumn("_seen", F.lit(True))
    condition = None
    for b in bucket:
        one = c(b) == c(f"_s_{b}")
        condition = one if condition is None else condition & one
    out = out.join(seen, condition & fit & c("_ts").isNull(), "left").drop(*[f"_s_{b}" for b in bucket])
    alike = c("group_size") > 1
    reason = (
        F.when(~c("is_valid"), "SKIPPED_INVALID_BY_PHASE2")
        .when(F.size("_missing") > 0, "EXCLUDED_MISSING_IDENTITY")
        .when(c("_price").isNull(), "EXCLUDED_UNUSABLE_PRICE")
        .when(c("_ts").isNull() & c("_seen"), "AMBIGUOUS_MISSING_TIMESTAMP")
        .when(~F.coalesce(alike, F.lit(False)), "RETAINED_UNIQUE")
        .when(c("canonical") == c("observation_id"), "RETAINED_CANONICAL_OF_DUPLICATE_GROUP")
        .when(c("_price") == "SOLD_OUT", "SOLD_OUT_TECHNICAL_DUPLICATE")
        .otherwise("TECHNICAL_DUPLICATE")
    )
    out = out.withColumn("duplicate_reason", reason)
    dup = c("duplicate_reason").isin("TECHNICAL_DUPLICATE", "SOLD_OUT_TECHNICAL_DUPLICATE")
    group = (
        F.when(~c("is_valid"), F.concat(F.lit("SKIPPED::"), c("observation_id")))
        .when(alike, F.concat(F.lit("DUPGRP-"), c("canonical")))
        .when(c("canonical").isNotNull(), F.concat(F.lit("SINGLETON::"), c("observation_id")))
        .otherwise(F.concat(F.lit("UNGROUPED::"), c("observation_id")))
    )
    out = out.withColumns({"duplicate_group_id": group, "is_duplicate": dup, "duplicate_of": F.when(dup, c("canonical")), "retained": c("is_valid") & ~dup})
    whole = Window.partitionBy("duplicate_group_id")
    sig = S.blank_to_null(c("capture_signature")) if "capture_signature" in validated.columns else F.lit(None).cast("string")
    agree = F.when(alike & (F.count(sig).over(whole) == F.count(F.lit(1)).over(whole)), F.min(sig).over(whole) == F.max(sig).over(whole))
    return out.withColumn("capture_signature_agreement", agree).drop("_missing", "_fare", "_ts", "_price", "_seen", "canonical", "group_size")


def canonical_view(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.where("is_valid and retained")


def duplicate_report(deduplicated: DataFrame) -> DataFrame:
    """One row a duplicate group; a group without exactly one canonical row raises."""
    ts = F.unix_seconds(_time(deduplicated).cast("timestamp"))
    groups = deduplicated.where("duplicate_group_id like 'DUPGRP-%'").groupBy("duplicate_group_id").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.when(~F.col("is_duplicate"), F.col("observation_id"))).alias("canonical_id"),
        F.count_if(~F.col("is_duplicate")).alias("_canonicals"),
        F.array_join(F.array_sort(F.collect_list("observation_id")), ";").alias("member_ids"),
        F.floor((F.max(ts) - F.min(ts)) / 60).cast("long").alias("max_delta_minutes"),
        F.first("capture_signature_agreement").alias("capture_signature_agreement"),
    )
    return groups.withColumn("canonical_id", F.when(F.col("_canonicals") == 1, F.col("canonical_id")).otherwise(F.raise_error(F.lit("a duplicate group needs exactly one canonical row")).cast("string"))).drop("_canonicals")
