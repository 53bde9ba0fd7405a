"""Declared text tables, guarded sinks, artifacts by content, verified snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The raw observation's columns, in order.
RAW_COLUMNS = ("observation_id", "capture_signature", "economic_signature", "origin", "destination", "carrier", "flight_number", "travel_date", "departure_time", "collection_timestamp", "advance_purchase_days", "advance_purchase_window", "fare_class", "base_fare", "taxes", "fees", "total_fare", "source", "availability_status")


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], columns=None, blank_is_null: bool = True) -> DataFrame:
    """A CSV with every column as text, and the header's byte-order mark removed.  The
    header must be ``columns`` where they are given."""
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
    if not blank_is_null:
        options |= {"nullValue": "\0", "emptyValue": ""}
    df = spark.read.options(**options).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if columns is not None and tuple(df.columns) != tuple(columns):
        raise ValueError(f"{path}: header {df.columns}")
    return df.replace("", None) if blank_is_null else df.fillna("")


def require(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def forbid(df: DataFrame, columns) -> DataFrame:
    found = [c for c in columns if c in df.columns]
    if found:
        raise ValueError(f"forbidden columns: {found}")
    return df


def write_table(df: DataFrame, path: str, columns, forbidden=(), order=(), kind: str = "parquet") -> None:
    """The declared columns in order, to Parquet, CSV or JSON.  ``order`` sorts within
    the files, by range, so that a total order costs no single task."""
    out = forbid(require(df, columns), forbidden).select(*columns)
    if order:
        out = out.orderBy(*order)
    writer = out.write.mode("overwrite")
    if kind == "csv":
        # As read_csv reads: quotes doubled, spaces kept, an empty text quoted and a null bare.
        writer.options(header=True, lineSep="\n", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Raw artifacts with the SHA-256 of their content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def store_artifacts(df: DataFrame, path: str) -> None:
    """(source, content) stored once each, by source and first digits of its digest."""
    digest = df.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["source", "sha256"])
    digest.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("source", "prefix").parquet(path)


#: A manifest: {"tables": {name: {"files": {file: sha256}, "columns": [...], "schema_version": v}}};
#: "file" and "sha256" may stand for a table of one file.
MANIFEST = "struct<tables:map<string,struct<files:map<string,string>,file:string,sha256:string,columns:array<string>,schema_version:string>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, columns, schema_version, files): a row a table, read by Spark."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m"))
    t = text.select(F.explode("m.tables").alias("name", "t"))
    return t.select("name", "t.columns", "t.schema_version", F.coalesce("t.files", F.create_map("t.file", "t.sha256")).alias("files"))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """(file, bytes, sha256, sha256_unix) of every file below a folder.  Executors read
    the files, one a row; the second digest takes line ends of either kind as the same."""
    at = re.sub(r"^[a-z0-9]+:/+", "/", root.rstrip("/"))
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.replace(F.decode("content", "ISO-8859-1"), F.lit("\r\n"), F.lit("\n"))
    relative = F.expr(f"substring(path, locate('{at}/', path) + {len(at) + 1})")
    return f.select(relative.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("sha256_unix"))


def verified(spark: SparkSession, root: str, manifest: str) -> DataFrame:
    """(name, file, status) of every file that the manifest names: MATCH, CHANGED or
    MISSING.  Digests are made and compared on executors."""
    named = read_manifest(spark, manifest).select("name", F.explode("files").alias("file", "expected"))
    found = named.join(digests(spark, root), "file", "left")
    same = (F.col("expected") == F.col("sha256")) | (F.col("expected") == F.col("sha256_unix"))
    return found.select("name", "file", F.when(F.col("sha256").isNull(), "MISSING").when(same, "MATCH").otherwise("CHANGED").alias("status"))


def load_snapshot(spark: SparkSession, root: str, manifest: str) -> dict[str, DataFrame]:
    """Published tables by name, once every file's bytes, each header and each schema
    version match the manifest; else none is published."""
    bad = verified(spark, root, manifest).where("status <> 'MATCH'").orderBy("name", "file").limit(20).collect()
    if bad:
        raise ValueError("content differs from the manifest: " + ", ".join(f"{r.name}: {r.file} {r.status}" for r in bad))
    out = {}
    for x in read_manifest(spark, manifest).collect():  # a row a table
        df = read_csv(spark, [f"{root}/{f}" for f in sorted(x.files)], x.columns)
        if "schema_version" in df.columns and not df.where(~F.col("schema_version").eqNullSafe(F.lit(x.schema_version))).isEmpty():
            raise ValueError(f"{x.name}: schema version is not {x.schema_version}")
        out[x.name] = df
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def monthly_gaps(months: DataFrame) -> DataFrame:
    """Months missing between the first and the last of (month yyyy-MM)."""
    d = F.to_date(F.concat("month", F.lit("-01")))
    span = months.agg(F.min(d).alias("a"), F.max(d).alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    return every.join(months.select("month").distinct(), "month", "left_anti")


def duplicates(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def synthetic_observations(spark: SparkSession, rows: int, seed: int = 7, routes=(("DEL", "BOM"), ("DEL", "BLR"), ("BOM", "GOI"))) -> DataFrame:
    """Seeded raw observations of any number, by hash of the row number alone."""
    h = lambda tag, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "id"), F.lit(n)).cast("int")
    pick = lambda tag, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), h(tag, len(xs)) + 1)
    pair = F.element_at(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in routes]), h("route", len(routes)) + 1)
    captured = F.timestamp_seconds(F.lit(1_790_000_000) + h("day", 10) * 86_400 + h("time", 1440) * 60).cast("timestamp_ntz")
    days = pick("days", [1, 7, 15, 30, 45])
    cents = F.lit(350_000) + h("fare", 400_000)
    money = lambda c: (c / 100).cast("decimal(18,2)").cast("string")
    sold = h("sold", 40) == 0
    window = F.element_at(F.create_map(*[F.lit(x) for kv in ((1, "T1(0-2)"), (7, "T7(5-9)"), (15, "T15(12-18)"), (30, "T30(25-35)"), (45, "T45(40-50)")) for x in kv]), days)
    base, taxes = F.floor(cents * 0.8).cast("long"), F.floor(cents * 0.15).cast("long")
    df = spark.range(rows).withColumn("captured", captured).withColumn("days", days)
    cols = {
        "observation_id": F.concat(F.lit("OBS"), F.lpad(F.col("id").cast("string"), 9, "0")), "origin": pair[0], "destination": pair[1], "carrier": pick("carrier", ["6E", "AI", "QP", "SG", "UK"]),
        "flight_number": F.concat(pick("carrier", ["6E", "AI", "QP", "SG", "UK"]), F.lit("-"), (h("flight", 900) + 100).cast("string")), "travel_date": F.date_format(F.date_add(F.col("captured").cast("date"), F.col("days")), "yyyy-MM-dd"),
        "departure_time": F.concat(F.lpad(h("hour", 24).cast("string"), 2, "0"), F.lit(":10")), "collection_timestamp": F.date_format("captured", "yyyy-MM-dd HH:mm"), "advance_purchase_days": F.col("days").cast("string"), "advance_purchase_window": window,
        "fare_class": pick("class", ["Economy Saver", "Economy Standard", "Economy Flexi"]), "base_fare": money(base), "taxes": money(taxes), "fees": money(cents - base - taxes), "total_fare": F.when(~sold, money(cents)),
        "source": pick("source", ["AirlineSite", "Cleartrip", "Goibibo", "MMT"]), "availability_status": F.when(sold, "Sold Out").otherwise("Available"),
    }
    out = df.select(*[v.alias(k) for k, v in cols.items()])
    sig = F.substring(F.md5(F.concat_ws("|", "flight_number", "fare_class", "travel_date", "source", "collection_timestamp")), 1, 12)
    economic = F.substring(F.md5(F.concat_ws("|", "origin", "destination", "fare_class", "travel_date", "advance_purchase_window")), 1, 12)
    return out.withColumns({"capture_signature": sig, "economic_signature": economic}).select(*RAW_COLUMNS)
