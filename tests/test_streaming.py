"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from faremill.operators import collection, dedup
from faremill.streaming import ingest


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def write(spark, folder, rows):
    """One file a batch, the last one an hour on, to move the watermark past the rest."""
    for k, part in enumerate((rows[::2], rows[1::2], [("end", "z", 6000)], [("end2", "z", 9000)])):
        df = spark.createDataFrame(part, "id string, bucket string, m int").withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).drop("m")
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("id string, bucket string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_sweep_equals_the_batch(spark, tmp_path):
    rows = [(f"{k:02d}", b, m) for k, (b, m) in enumerate([("a", 1), ("a", 16), ("a", 17), ("b", 3), ("a", 20), ("b", 18), ("b", 19), ("a", 33), ("a", 400)])]
    stream = write(spark, str(tmp_path / "in"), rows)
    out = run(spark, ingest.sweep(stream, ["bucket"], "ts", "id", late="10 hours"), "swept")
    batch = dedup.anchored_sweep(spark.read.parquet(str(tmp_path / "in")).where("bucket <> 'z'"), ["bucket"], "ts", "id")
    assert {(r.id, r.canonical) for r in out.where("bucket <> 'z'").collect()} == {(r.id, r.canonical) for r in batch.collect()}


def test_streamed_days_and_rounds(spark, tmp_path):
    rows = [(f"{k:02d}", "a", 60 * 9 + 200 * k) for k in range(12)]
    stream = write(spark, str(tmp_path / "in"), rows)
    days = {r.day: r.n for r in run(spark, ingest.daily_counts(stream, "ts", "1 day"), "days").collect()}
    assert days["1970-01-01"] == 5
    r = run(spark, ingest.rounds(stream, "ts", "id"), "rounds")
    assert r.where("round_alignment = 'ANCHORED'").count() >= 1 and r.count() == 14


def quotes(spark, folder, batches):
    """One file a batch of (query_id, minute)."""
    for rows in batches:
        df = spark.createDataFrame(rows, "query_id string, m int").withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).drop("m")
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("query_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def test_expiries_equal_the_batch_at_every_watermark(spark, tmp_path):
    """Renewed quotes, captures out of order, repeats, and one at the very end of a life."""
    batches = [[("a", 0), ("b", 10), ("c", 5), ("a", 0)], [("a", 90), ("d", 60), ("d", 180)], [("b", 70), ("e", 200), ("f", 100)], [("a", 215), ("g", 400), (None, 3)], [("a", 401), ("h", 700)], [("z", 2000)]]
    stream = quotes(spark, str(tmp_path / "in"), batches)
    got = []

    def keep(df, batch_id):
        got.extend((batch_id, r.query_id, r.collected_at, r.expired_at) for r in df.collect())

    q = ingest.expiries(stream, "query_id", "ts", 2, "3 hours").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    marks = {p.batchId: p.eventTime.get("watermark") for p in q.recentProgress}
    assert len(marks) >= 6
    table = spark.read.parquet(str(tmp_path / "in"))
    seen = set()
    for batch, mark in sorted(marks.items()):
        new = [(i, c, e) for b, i, c, e in got if b == batch]
        assert not seen & set(new) and len(new) == len(set(new))
        seen |= set(new)
        want = collection.expiries(table, F.lit(mark).cast("timestamp"), 2, at="ts").collect() if mark else []
        assert seen == {(r.query_id, r.collected_at, r.expired_at) for r in want}
    assert len(seen) >= 9 and {i for i, _, _ in seen} == set("abcdefgh")


def test_late_rows_go_to_a_table_of_their_own(spark, tmp_path):
    """On time and late rows are the input; a batch that fails half way and is replayed
    changes nothing."""
    batches = [[("a", 100), ("b", 130)], [("c", 90), ("d", 101), (None, 300)], [("e", 269), ("f", 270), ("g", 50)], [("h", 1000)], [("i", 969), ("j", 971)]]
    stream = quotes(spark, str(tmp_path / "in"), batches)
    sink, failed = ingest.Delivery(str(tmp_path / "out"), "ts", "30 minutes"), []

    class Failing(ingest.Delivery):
        def mark(self, session, batch_id):
            if batch_id == 2 and len(failed) == 1:
                failed.append("again")
                raise RuntimeError("lost")
            return super().mark(session, batch_id)

        def __call__(self, batch, batch_id):
            if batch_id == 2 and not failed:
                failed.append("half")
                ingest.split_late(batch, "ts", None)[0].limit(1).write.mode("overwrite").parquet(f"{self.path}/on_time/batch_id=2")
                raise RuntimeError("lost")
            super().__call__(batch, batch_id)

    for _ in range(3):
        q = stream.writeStream.foreachBatch(Failing(str(tmp_path / "out"), "ts", "30 minutes")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:
            pass
    assert failed == ["half", "again"]
    rows = {name: sorted((r.query_id or "", r.batch_id) for r in sink.table(spark, name, "query_id string, ts timestamp").collect()) for name in ("on_time", "late")}
    assert rows["late"] == [("c", 1), ("e", 2), ("g", 2), ("i", 4)]
    assert sorted(i for part in rows.values() for i, _ in part) == sorted(i or "" for b in batches for i, _ in b)
    # A replay of a batch that was delivered.
    batch = spark.createDataFrame([(i, m) for i, m in batches[2]], "query_id string, m int").select("query_id", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    sink(batch, 2)
    assert {name: sorted((r.query_id or "", r.batch_id) for r in sink.table(spark, name, "query_id string, ts timestamp").collect()) for name in rows} == rows
