"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of docs, whatever other columns these have.  Nulls, repeated rows and ids are treated
as the operators' docstrings say; rows that share a doc_id, or have none, are told
apart by their place in the order of (doc_id, hash of the row), nulls first, which a
rerun finds again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faremill.llm import common
from faremill.llm.exact_dedup import exact_duplicates
from faremill.llm.mixing import mixed
from faremill.llm.packing import packed
from faremill.llm.quality import of_quality
from faremill.llm.simhash_dedup import near_duplicates


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source, row) with an id of its own for each row: doc_id itself
    where it can serve."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), "text", "source", F.struct(*columns).alias("row"))
    if docs.groupBy(doc_id.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or k is null").isEmpty():
        return rows
    # Rows alike in doc_id and hash are alike, so any order of them gives the same ids; a
    # random third key lets them be dealt out.
    order = [F.col("doc_id").asc_nulls_first(), "h", "r"]
    dealt = rows.withColumns({"h": F.xxhash64("row"), "r": F.rand(7)}).repartitionByRange(common.shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt = common.materialize(dealt.drop("h", "r").withColumn("at", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumns({"part": F.shiftright("at", 33), "nth": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("at")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("start"))  # a row a partition
    return dealt.join(F.broadcast(starts), "part").select((F.col("start") + F.col("nth")).alias("doc_id"), "text", "source", "row")


def _rows(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select("row.*").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality stay."""
    return of_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts equal up to the case of A-Z stays."""
    keyed = _keyed(docs)
    return _rows(keyed.join(exact_duplicates(keyed).where("kept").select("doc_id").hint("merge"), "doc_id"), docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document that names it stays."""
    keyed = _keyed(docs)
    return _rows(keyed.join(near_duplicates(keyed).where("doc_id = component_id").select("doc_id").hint("merge"), "doc_id"), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as rows: a document comes once for each epoch that takes it, and the
    one at its source's cut comes with its first words, as many as the budget leaves.
    Documents without words are in no budget and go."""
    keyed = _keyed(docs)
    taken = mixed(keyed).where("taken > 0").select("doc_id", "size", "taken")
    rows = keyed.select("doc_id", "row").join(taken.hint("merge"), "doc_id").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("cut", F.when(words < F.col("size"), head))
    out = []
    for c in docs.columns:
        whole = F.col(f"row.`{c}`")
        new = {"text": F.col("cut"), "n_chars": F.length("cut")}.get(c)
        out.append((whole if new is None else F.when(F.col("cut").isNull(), whole).otherwise(new.cast(docs.schema[c].dataType))).alias(c))
    return rows.select(*out)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of the mix, piece by piece, with the bin that trains on it."""
    return packed(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can state neither the trained model nor XXH64 fingerprints.
ORACLE_SQL = None
