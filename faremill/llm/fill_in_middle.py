"""Fill-in-middle transformation, on Spark SQL functions alone.

A text is the array of its code points (``regexp_extract_all``).  Four numbers from
the SHA-256 of the document's id give two cuts and the form, so a rerun, or a run over
other documents beside it, makes the same examples.  Prefix, middle and suffix are
slices of the array, joined with sentinels between them; the sentinels of an example
give its parts back, whichever form it has.  Every row is made on its own: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Sentinels of prefix, suffix and middle.  A text that holds one is left plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "1:"
#: Hundredths: texts that are transformed at all, and of these the ones in spm order.
TRANSFORMED, SUFFIX_FIRST = 90, 20


def numbers(doc_id: Column, salt: str = SALT) -> list[Column]:
    """Four unsigned 32-bit numbers of an id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, salt: str = SALT) -> DataFrame:
    """(doc_id, text) -> doc_id, text, n, form, prefix_chars, middle_chars, output.

    ``form`` is plain, psm or spm; ``n`` counts code points, as the two lengths do, which
    are null where the form is plain.  A null text is the empty one; empty texts, and
    texts with a sentinel in them, are plain.  Rows are independent: repeated ones give
    repeated examples, rows of one id are cut by the same numbers.  An empty table gives
    an empty one; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)))
    n = F.size("units")
    rows = rows.withColumn("n", n.cast("long")).withColumns({f"h{k}": h for k, h in enumerate(numbers(F.col("doc_id"), salt), 1)})
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= transformed), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.withColumns({"form": form, "a": F.least(one, two).cast("int"), "b": F.greatest(one, two).cast("int")})
    part = lambda start, length: F.array_join(F.slice("units", start + 1, length), "")
    pieces = {"prefix": part(F.lit(0), F.col("a")), "middle": part(F.col("a"), F.col("b") - F.col("a")), "suffix": part(F.col("b"), F.col("n").cast("int") - F.col("b"))}
    cut = F.col("form") != "plain"
    rows = rows.withColumns({k: F.when(cut, x) for k, x in pieces.items()})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.when(cut, F.col("a").cast("long")).alias("prefix_chars"),
        F.when(cut, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text of an example, from its sentinels.  A sentinel begins with a sign that it
    holds nowhere else, so neighbouring text cannot make another one with its ends."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    psm, spm = (F.concat(*[F.element_at(parts, i) for i in order]) for order in ((2, 4, 3), (3, 4, 2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.documents(spark, sf_dir))
    sha = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
