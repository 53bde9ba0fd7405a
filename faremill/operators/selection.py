"""Exact order statistics of groups of any size, by counting.

``median`` and ``percentile`` keep each distinct value of a group in one buffer.  Here a
group's values are counted, distinct value by distinct value, wherever they lie; sums of
the counts by leading digits tell in which range a wanted rank falls, and the next pass
looks at that range only.  Windows see one group's ranges, or one range's values, at a
time: a few ten thousand rows however large the group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits that a pass leaves open; with these a range holds 65,536 ranges of the next pass.
PASSES = (32, 16, 0)


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks, passes: tuple[int, ...] = PASSES) -> DataFrame:
    """(keys, name, rank, value, n): of each group the values at the given ranks, from 0.

    ``value`` is a whole number; nulls are left out, and so are groups without another
    value.  ``ranks``: from the column of a group's count to {name: rank}.  Null keys are
    a group.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("long").alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    named = lambda n: F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks(n).items()]))
    wanted, above = None, None
    for bits in passes:
        place = F.shiftright("v", bits).alias("d")
        if wanted is None:  # all ranges of a group, and its count with them
            part = ["g"]
            ranges = counts.groupBy("g", place).agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
        else:  # the ranges within the one that a rank was found in
            part = ["g", "name"]
            inner = counts.withColumn("up", F.shiftright("v", above))
            inner = inner.select("g", "up", "n", place) if bits == 0 else inner.groupBy("g", "up", place).agg(F.sum("n").alias("n"))
            ranges = inner.join(wanted, ["g", "up"])
        upto = F.sum("n").over(Window.partitionBy(*part).orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
        ranges = ranges.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        if wanted is None:
            ranges = ranges.withColumn("w", named(F.col("total"))).withColumns({"name": F.col("w.name"), "rank": F.col("w.rank"), "left": F.col("w.rank")})
        found = ranges.where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("upto")))
        wanted = found.select("g", "total", "name", "rank", (F.col("left") - F.col("before")).alias("left"), F.col("d").alias("up"))
        above = bits
    return wanted.select(*[F.col("g").getField(k).alias(k) for k in keys], "name", "rank", F.col("up").alias("value"), F.col("total").alias("n"))


def quantiles(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], passes: tuple[int, ...] = PASSES) -> DataFrame:
    """(keys, n, a column a fraction): quantiles between the two nearest values, as
    ``percentile`` has them.  Without keys there is one row, of nulls if nothing counts."""
    place = lambda n, p: (n - 1) * F.lit(float(p))
    ranks = lambda n: {f"{name}{end}": cut(place(n, p)) for name, p in fractions.items() for end, cut in (("<", F.floor), (">", F.ceil))}
    found = order_statistics(rows, keys, value, ranks, passes)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    between = lambda name, p: at(f"{name}<") + (at(f"{name}>") - at(f"{name}<")) * (place(F.max("n"), p) - F.floor(place(F.max("n"), p)))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[between(name, p).alias(name) for name, p in fractions.items()])


def midpoints(rows: DataFrame, keys: list[str], cents: str, passes: tuple[int, ...] = PASSES) -> DataFrame:
    """(keys, n, median_cents): medians, half a cent rounded up."""
    return quantiles(rows, keys, cents, {"median_cents": 0.5}, passes).withColumn("median_cents", F.floor(F.col("median_cents") + 0.5).cast("long"))
