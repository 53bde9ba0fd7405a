"""Order statistics by counting, distributed ordinals, snapshots, lookups, payloads."""

import random

import pytest
from pyspark.sql import functions as F

from faremill.operators import selection


@pytest.mark.parametrize("seed, top", [(1, 10), (2, 1 << 20), (3, 1 << 40)])
def test_quantiles_equal_percentile(spark, seed, top):
    """Ties, negative values, null values and keys, groups of one row, one large group."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([None, *[rng.randrange(-top, top) for _ in range(9)]])) for _ in range(3000)] + [("one", 0, 7), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, j int, v long")
    for passes in (selection.PASSES, (16, 0), (40, 20, 8, 0)):
        got = {(r.k, r.j): (r.n, r.q1, r.med, r.p9) for r in selection.quantiles(df, ["k", "j"], "v", {"q1": 0.25, "med": 0.5, "p9": 0.9}, passes).collect()}
        want = df.where("v is not null").groupBy("k", "j").agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(p)).alias(f"p{i}") for i, p in enumerate((0.25, 0.5, 0.9))]).collect()
        assert got.keys() == {(r.k, r.j) for r in want} and ("none", 0) not in got
        for r in want:
            assert got[r.k, r.j][0] == r.n and got[r.k, r.j][1:] == pytest.approx((r.p0, r.p1, r.p2), rel=1e-12)


def test_midpoint_of_one_group_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003 - 500_000).alias("v"))
    assert selection.midpoints(df, [], "v").first()[:] == (1_000_000, df.agg(F.floor(F.median("v") + 0.5)).first()[0])
    plan = selection.midpoints(df, [], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan and "collect_list" not in plan


def test_a_group_is_never_in_one_window(spark):
    """Windows are over the ranges of a range, so at most 65,536 rows of a group."""
    df = spark.range(300_000).select((F.col("id") * 1_000_003).alias("v"))
    assert selection.quantiles(df, [], "v", {"m": 0.5}).first().m == df.agg(F.median("v")).first()[0]
    assert selection.quantiles(df.where("false"), [], "v", {"m": 0.5}).first()[:] == (None, None)
    assert selection.quantiles(df.where("false").withColumn("k", F.lit(1)), ["k"], "v", {"m": 0.5}).count() == 0


# --- total order -----------------------------------------------------------------------
def test_numbered_rows_stand_in_one_order(spark):
    from faremill.sources import ordered

    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice(["b", "a", None])) for i in range(3000)] + [(i, 5, "hot") for i in range(3000, 5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, rank int, name string").repartition(5)
    order = [F.col("rank").asc_nulls_last(), F.col("name").desc_nulls_first(), F.col("id")]
    got = [r.id for r in ordered.numbered(df, order).orderBy("ordinal").collect()]
    want = [i for i, *_ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, -ord(r[2][0]) if r[2] else 0, r[0]))]
    assert [r.ordinal for r in ordered.numbered(df, order).select("ordinal").orderBy("ordinal").collect()] == list(range(1, 5001))
    assert got == want
    assert ordered.numbered(df.where("false"), order).count() == 0


def test_published_versions_appear_at_once(spark, tmp_path, monkeypatch):
    from faremill.sources import ordered

    df = spark.range(1000).select((999 - F.col("id")).alias("k"), F.lit("x").alias("secret"))
    at = str(tmp_path / "t")
    with pytest.raises(ValueError, match="nothing"):
        ordered.published(spark, at)
    ordered.publish(df, at, ["k"], [F.col("k")])
    first = ordered.published(spark, at)
    assert first.columns == ["ordinal", "k"] and first.where("ordinal <> k + 1").count() == 0
    ends = [(r[1], r[2]) for r in first.groupBy(F.input_file_name()).agg(F.min("k"), F.max("k")).collect()]
    assert all(a[1] < b[0] for a, b in zip(sorted(ends), sorted(ends)[1:]))  # files do not overlap
    with pytest.raises(ValueError, match="forbidden"):
        ordered.publish(df, at, ["k"], [F.col("k")], forbidden=["secret"])
    monkeypatch.setattr(ordered, "_log", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):  # the files of a version are there, its line in the log is not
        ordered.publish(df.where("k < 5"), at, ["k"], [F.col("k")])
    monkeypatch.undo()
    assert ordered.published(spark, at).count() == 1000
    ordered.publish(df.where("k < 7"), at, ["k"], [F.col("k")])
    assert ordered.published(spark, at).count() == 7


# --- snapshots ------------------------------------------------------------------------------
def test_a_changed_byte_in_one_of_many_files_is_found(spark, tmp_path, monkeypatch):
    import builtins
    import hashlib
    import json

    from faremill.sources import tables

    (tmp_path / "data").mkdir()
    sha, files = lambda b: hashlib.sha256(b).hexdigest(), {}
    for k in range(40):
        body = f"id,schema_version\n{k},v1\n".encode()
        (tmp_path / "data" / f"p{k}.csv").write_bytes(body.replace(b"\n", b"\r\n") if k % 3 else body)
        files[f"p{k}.csv"] = sha(body)
    (tmp_path / "data" / "one.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,2\n")
    manifest = {"tables": {"many": {"files": files, "columns": ["id", "schema_version"], "schema_version": "v1"}, "one": {"file": "one.csv", "sha256": sha(b"\xef\xbb\xbfa,b\n1,2\n"), "columns": ["a", "b"], "schema_version": "v1"}}}
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    read, root, at = builtins.open, str(tmp_path / "data"), str(tmp_path / "m.json")
    monkeypatch.setattr(builtins, "open", lambda f, *a, **b: pytest.fail(f"the driver opens {f}") if str(tmp_path) in str(f) else read(f, *a, **b))
    got = tables.load_snapshot(spark, root, at)
    assert got["many"].count() == 40 and got["one"].count() == 1 and spark.table("many").count() == 40
    monkeypatch.undo()
    spark.catalog.dropTempView("many"), spark.catalog.dropTempView("one")
    (tmp_path / "data" / "p17.csv").write_bytes(b"id,schema_version\n71,v1\n")
    (tmp_path / "data" / "p18.csv").unlink()
    status = {r.file: r.status for r in tables.verified(spark, root, at).collect()}
    assert {f for f, s in status.items() if s != "MATCH"} == {"p17.csv", "p18.csv"} and (status["p17.csv"], status["p18.csv"]) == ("CHANGED", "MISSING") and len(status) == 41
    with pytest.raises(ValueError, match="many: p17.csv CHANGED, many: p18.csv MISSING"):
        tables.load_snapshot(spark, root, at)
    assert not spark.catalog.tableExists("one")


# --- lookups, payloads, pages -------------------------------------------------------------------
def test_lookups_in_order_of_preference(spark):
    from faremill.operators import lookup

    table = lambda rows: spark.createDataFrame(rows, "city string, value string")
    first, second = table([("A", "a1"), ("B", None), ("D", "d1"), ("D", "d2"), ("A", "a1"), (None, "x")]), table([("A", "z"), ("B", "b1"), ("D", "d1")])
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, None), (6, "A")], "id int, city string")
    got = {r.id: (r.code, r.lookup_source, r.mapping_status, r.review_reason) for r in lookup.looked_up(rows, "city", {"one": first, "two": second}, "code").collect()}
    none = (None, None, "FLAG_FOR_REVIEW", "NO_SOURCE")
    assert got == {1: ("a1", "one", "MAPPED", None), 6: ("a1", "one", "MAPPED", None), 2: ("b1", "two", "MAPPED", None), 3: none, 5: none, 4: (None, "one", "FLAG_FOR_REVIEW", "SEVERAL_VALUES")}


def test_offers_of_any_shape(spark):
    from decimal import Decimal

    from faremill.operators import collection

    bodies = [
        ("search", '{"best_flights":[{"price":"12.50","flights":[{"departure_airport":{"id":"DEL"}}]},{"price":0},{"price":"free"},7,null,{"price":1e2,"currency":["INR"]}]}'),
        ("search", '{"best_flights":{"x":{"price":3}}}'),
        ("search", '{"best_flights":[]}'),
        ("partner", '{"content":{"results":{"k":{"pricing":{"total":"9"},"leg":{"number":12},"cabin":"E"}}}}'),
        ("partner", '{"content":[]}'),
        ("partner", "[]"),
        ("partner", None),
        ("partner", "{"),
        ("other", '{"best_flights":[{"price":1}]}'),
        (None, "{}"),
    ]
    p = spark.createDataFrame([(str(k), *b, "t") for k, b in enumerate(bodies)], "query_id string, provider string, payload string, collected_at string")
    got = sorted((r.query_id, r.position, r.price, r.currency, r.origin, r.flight_number, r.fare_class) for r in collection.provider_offers(p).collect())
    assert got == [("0", "0", Decimal("12.50"), None, "DEL", None, None), ("0", "5", Decimal("100.00"), '["INR"]', None, None, None), ("1", "x", Decimal("3.00"), None, None, None, None), ("3", "k", Decimal("9.00"), None, None, "12", "E")]


def test_page_bundle_is_one_scan(spark):
    from faremill.operators import dashboard

    rows = [("A-B", "2026-09-01 09:00", "HIGH", "x", 100, 2, 1), ("A-B", "2026-09-02 09:00", None, "x", None, 1, 0), (None, "2026-09-01 09:00", "NONE", None, 300, 1, 0)]
    df = spark.createDataFrame(rows, "route_id string, round_sort_key string, severity string, fare_class string, fare_cents long, observations long, sold_out_observations long")
    out = dashboard.page_bundle(df)
    got = {(r.section, r.key, r.measure): r.value for r in out.collect()}
    assert got["TOTAL", "", "cells"] == 3 and got["TOTAL", "", "average_fare"] == 2 and got["ROUTE", "-", "cells"] == 1 and got["SEVERITY", "NONE", "cells"] == 2
    assert got["ROUTE_ROUND", "A-B|2026-09-02 09:00", "priced_pct"] == 0 and ("ROUTE_ROUND", "A-B|2026-09-02 09:00", "average_fare") not in got and got["DAY", "2026-09-01", "review_cells"] == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Expand" in plan
    assert dashboard.page_bundle(df.where("false")).where("section <> 'TOTAL'").count() == 0
