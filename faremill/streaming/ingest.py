"""Structured Streaming ingest whose results equal the batch operators'."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import scalars as S
from ..sources import scratch


def rounds(stream: DataFrame, ts: str, observation_id: str) -> DataFrame:
    """Round assignment is a function of the row, so it streams as it is."""
    r = S.collection_round(F.col(ts).cast("timestamp_ntz"), F.col(observation_id).cast("string"))
    return stream.withColumns({"collection_round_id": r["round_id"], "round_alignment": r["alignment"]})


def daily_counts(stream: DataFrame, ts: str, late: str = "30 minutes") -> DataFrame:
    """Tumbling days; rows later than the watermark are not counted (``split_late``
    keeps them)."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def sweep(stream: DataFrame, bucket: list[str], ts: str, order: str, tolerance_minutes: int = S.DUPLICATE_TOLERANCE_MINUTES, late: str = "30 minutes") -> DataFrame:
    """The anchored sweep over a stream: (bucket, order, canonical).

    State of a bucket: rows not yet settled and the open group's anchor.  A row is
    settled, in time order, once the watermark has passed it; the state goes when the
    bucket has been quiet for longer than the tolerance.
    """
    seconds = tolerance_minutes * 60
    keyed = stream.withWatermark(ts, late).select(F.concat_ws("\x1f", *[F.coalesce(F.col(b).cast("string"), F.lit("\0")) for b in bucket]).alias("bucket"), F.col(ts).alias("ts"), F.col(order).cast("string").alias("id"))

    def settle(key, frames, state: GroupState):
        held, anchor = ([tuple(x) for x in state.get[0]], state.get[1]) if state.exists else ([], None)
        for f in frames:
            held += [(int(t.timestamp()), i) for t, i in zip(pd.to_datetime(f["ts"], utc=True), f["id"])]
        mark = state.getCurrentWatermarkMs() // 1000
        held.sort()
        done = [x for x in held if x[0] <= mark]
        held = held[len(done) :]
        out = []
        anchor = tuple(anchor) if anchor else None
        for t, i in done:
            if anchor is None or t - anchor[0] > seconds:
                anchor = (t, i)
            out.append((key[0], i, anchor[1]))
        if held or (anchor and anchor[0] + seconds > mark):
            state.update((held, anchor))
            state.setTimeoutTimestamp(max(mark + 1, (held[0][0] if held else anchor[0] + seconds)) * 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["bucket", "id", "canonical"])

    return keyed.groupBy("bucket").applyInPandasWithState(settle, "bucket string, id string, canonical string", "held array<struct<t:long,id:string>>, anchor struct<t:long,id:string>", "append", GroupStateTimeout.EventTimeTimeout)


def split_late(batch: DataFrame, ts: str, mark) -> tuple[DataFrame, DataFrame]:
    """(in time, late) of a micro-batch: a row is late if it lies before the mark; without
    a mark none is, and a row without a time never is."""
    late = F.coalesce(F.col(ts) < F.lit(mark).cast("timestamp"), F.lit(False))
    return batch.where(~late), batch.where(late)


class Delivery:
    """A ``foreachBatch`` sink that keeps every row: those in time below ``on_time``, the
    late ones below ``late``, each batch in a folder of its own.

    The mark of a batch is the latest time of the batches before it, less the delay, as
    for a watermark.  Each batch notes its latest time below ``marks``.  All three are
    overwritten by batch id, and a batch reads the notes of earlier ones only, so a batch
    that is replayed, after a failure at any point, leaves what it left before.
    """

    def __init__(self, path: str, ts: str, late: str = "30 minutes"):
        self.path, self.ts, self.delay = path.rstrip("/"), ts, late

    def _notes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("latest timestamp, batch_id long").parquet(f"{self.path}/marks")

    def mark(self, spark: SparkSession, batch_id: int):
        """The mark of a batch, or None for the first one."""
        if batch_id == 0:
            return None
        earlier = self._notes(spark).where(F.col("batch_id") < batch_id)
        return earlier.agg((F.max("latest") - F.expr(f"interval {self.delay}")).alias("m")).first().m

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = self.mark(spark, batch_id)
        batch = batch.persist()
        try:
            for name, rows in zip(("on_time", "late"), split_late(batch, self.ts, mark)):
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")
            batch.agg(F.max(F.col(self.ts).cast("timestamp")).alias("latest")).write.mode("overwrite").parquet(f"{self.path}/marks/batch_id={batch_id}")
        finally:
            batch.unpersist()

    def table(self, spark: SparkSession, name: str, schema) -> DataFrame:
        """``on_time`` or ``late``, with batch_id."""
        return spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").withColumn("batch_id", F.regexp_extract(F.input_file_name(), r"batch_id=(\d+)", 1).cast("long"))


class _Expiry(StatefulProcessor):
    """Captures of one query that may still expire, as one value in time order, with a
    timer at the earliest end.  All that a timer finds ended goes at once, so a query
    costs a few calls of the state a batch, however many captures it has."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at array<long>")

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(at + self.life - 1)  # a timer fires once the mark is beyond it

    def handleInputRows(self, key, rows, timerValues):
        held = self.held.get()
        old = list(held[0]) if held else []
        new = sorted({row["at"] for row in rows}.union(old))
        if len(new) > len(old):
            self.held.update((new,))
            if not old or new[0] < old[0]:
                self._timer(new[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.held.get()
        held = list(held[0]) if held else []
        ended = bisect.bisect_right(held, timerValues.getCurrentWatermarkInMs() - self.life)
        if not ended:  # an earlier timer has settled what this one was for
            return
        for at, later in zip(held[:ended], held[1 : ended + 1] + [None]):
            if later is None or later >= at + self.life:
                yield Row(query_id=key[0], at=at)
        if ended < len(held):
            self.held.update((held[ended:],))
            self._timer(held[ended])
        else:
            self.held.clear()

    def close(self) -> None:
        pass


#: transformWithState keeps its timers in this store.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def expiries(stream: DataFrame, query_id: str, ts: str, hours: int = 2, late: str = "30 minutes") -> DataFrame:
    """(query_id, collected_at, expired_at) of each quote, emitted once the watermark has
    reached the end of its time to live, unless the same query was captured anew before
    that.  What expires goes from the state.  Equal to ``collection.expiries`` of all
    rows that were not late, at every watermark."""
    stream.sparkSession.conf.set(*ROCKSDB)
    life = hours * 3_600_000
    rows = stream.withWatermark(ts, late).where(F.col(ts).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).cast("string").alias("query_id"), F.unix_millis(F.col(ts)).alias("at"), F.col(ts).alias("event_time"))
    out = rows.groupBy("query_id").transformWithState(_Expiry(life), "query_id string, at long", "Append", "EventTime")
    return out.select("query_id", F.timestamp_millis("at").alias("collected_at"), F.timestamp_millis(F.col("at") + life).alias("expired_at"))


def replayed(stream: DataFrame, tag: str) -> DataFrame:
    """What a stream of the files there are appends in all, as a table."""
    spark = stream.sparkSession
    path = scratch.folder(spark, tag)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    scratch.dropped_at_exit(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def live_quotes(stream: DataFrame, ts: str, hours: int = 2) -> DataFrame:
    """Each quote once within its time to live: the watermark drops the state of older
    ones."""
    return stream.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark(["query_id"])
