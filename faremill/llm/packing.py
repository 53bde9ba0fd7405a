"""Conflict-constrained best-fit packing of documents into training sequences.

Bins are kept ordered by residual.  Each carries a bitmap of the duplicate clusters
in it and ``slots`` bitmaps of sources, one for each piece that a bin may take of one
source.  A piece starts at the least residual that holds it and moves on to the next
larger one until a bin takes it: its cluster is not there yet and its source has a
slot left.  Otherwise it opens a bin.

Pieces are dealt by a hash of what they are (reruns agree) to shards of about ``SHARD`` pieces, packed on their own
and largest first, so any number of documents packs in parallel, and the bins that a
shard leaves open are few against those it fills.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, SLOTS, SHARD = 4096, 8, 20_000


def _sized(batches):
    """Word count and duplicate cluster (a hash of the text, A-Z lower-cased)."""
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        view, sizes = memoryview(data), np.zeros(len(offs) - 1, np.int64)
        for a, b in common.row_chunks(offs):
            lo = offs[a]
            sizes[a:b] = np.diff(common.word_spans(data[lo : offs[b]], offs[a : b + 1] - lo)[2])
        clusters = np.array([xxhash.xxh64_intdigest(bytes(view[a:b]).lower()) for a, b in zip(offs[:-1], offs[1:])], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array(sizes), pa.array(clusters.view(np.int64))], names=["doc_id", "source", "size", "cluster"])


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, slots: int) -> list[int]:
    """Bin of each piece, in the given order.  ``sources`` and ``clusters`` are bits."""
    order: list[tuple[int, int]] = []
    held: list[int] = []
    taken: list[list[int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not (held[b] & cluster or taken[b][-1] & source):
                break
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(held)
            held.append(0)
            taken.append([0] * slots)
        held[b] |= cluster
        for k in range(slots):
            if not taken[b][k] & source:
                taken[b][k] |= source
                break
        if left > size:
            insort(order, (left - size, b))
        out.append(b)
    return out


def _pack(table: pa.Table, capacity: int, slots: int) -> pa.Table:
    size, doc = table["n_words"].to_numpy(), np.array(table["doc_id"].fill_null(-(2**63)).to_numpy())
    names, source = np.unique(np.array(["\0" if x is None else "s" + x for x in table["source"].to_pylist()], dtype=object), return_inverse=True)
    order = np.lexsort((table["nth"].to_numpy(), table["piece"].to_numpy(), table["cluster"].to_numpy(), source, doc, -size))
    table, source = table.take(pa.array(order)), source[order]
    size = table["n_words"].to_numpy()
    _, cluster, times = np.unique(table["cluster"].to_numpy(), return_inverse=True, return_counts=True)
    bit = np.full(len(times), -1)
    bit[times > 1] = np.arange(int((times > 1).sum()))
    bins = np.array(best_fit(size.tolist(), [1 << int(s) for s in source], [0 if k < 0 else 1 << int(k) for k in bit[cluster]], capacity, slots), dtype=np.int64)
    fill = np.bincount(bins, weights=size).astype(np.int64)
    shard = table["shard"][0].as_py()
    return pa.table({"doc_id": table["doc_id"], "piece": table["piece"], "start_word": table["start_word"], "n_words": table["n_words"], "bin_id": pa.array((shard << 32) + bins), "bin_words": pa.array(fill[bins])})


def packed(docs: DataFrame, capacity: int = CAPACITY, slots: int = SLOTS) -> DataFrame:
    """Per piece of each row of ``docs`` (doc_id, text, source): doc_id, piece,
    start_word, n_words, bin_id, bin_words (the words in its bin).

    A text of more than ``capacity`` words is cut into pieces of that many and a
    rest.  No bin holds more words than ``capacity``, two pieces of one duplicate
    cluster (equal texts up to the case of A-Z, and the pieces of one text), or more
    than ``slots`` pieces of one source; null is a source of its own.  Null and empty
    texts have one piece without words and no bin.  A repeated row is packed like any
    other of its cluster; reruns give the same bins; a null doc_id stays null.  Other columns are not read.  An
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    sized = common.materialize(rows.mapInArrow(_sized, "doc_id long, source string, size long, cluster long"), "sized")
    # Rows alike are told apart by a number, whichever of them comes first.
    alike = sized.groupBy("doc_id", "source", "size", "cluster").agg(F.count(F.lit(1)).alias("times"))
    pieces = common.repeated(alike, "times", "nth").withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity)).cast("int"))))
    pieces = pieces.withColumn("start_word", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start_word")))
    shards = max(1, -(-int(sized.agg(F.sum(F.ceil(F.col("size") / capacity))).first()[0] or 0) // SHARD))
    dealt = pieces.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "nth", "piece"), F.lit(shards)))
    placed = dealt.groupBy("shard").applyInArrow(lambda t: _pack(t, capacity, slots), "doc_id long, piece int, start_word long, n_words long, bin_id long, bin_words long")
    empty = pieces.where("n_words = 0").select("doc_id", "piece", "start_word", "n_words", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_words"))
    return placed.unionByName(empty)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))
