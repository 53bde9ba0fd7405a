"""Exact deduplication by Golomb-coded fingerprint exchange.

1. Each task cuts its rows into blocks, sorts a block's 48-bit fingerprints, cuts
   them by owner (a range of fingerprints) and sends each owner its part as
   Golomb-coded gaps;
2. an owner decodes what it got and answers each block with a bitmap of the
   fingerprints that another block has too;
3. only the rows marked there, or repeated within their own block, are suspects:
   their texts are shuffled and grouped by their bytes, which settles the groups.

How the second scan knows the suspects: their SHA-256 values set bits of a filter of
``BITS_EACH`` bits a suspect, ``MOST_BITS`` (32 MB) at most, which every task gets.  A
text that is no suspect passes it with a chance of about one in a hundred, and then is
alone in its group.  Beyond some 27 million suspects the filter is full: more texts
travel, and the results stay the same.

A text seen a million times crosses the exchange once a block, and the grouping
pre-aggregates.  Groups larger than half a partition are fewer than twice the
partitions: their rows meet them by broadcast, so no group gathers in one task.  The
scratch table of blocks keeps every row's id and SHA-256.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FINGERPRINT_BITS, BLOCK_ROWS = 48, 1 << 16
BITS_EACH, MOST_BITS, PROBES = 10, 1 << 28, 4
#: Rows whose fingerprints one owner decodes at once, on average, at most.
OWNED = 1 << 22
_BLOCK = "block long, owner int, base long, shift int, n int, codes binary, repeated binary, rows array<int>, ids array<long>, shas binary"


def golomb_encode(values: np.ndarray, base: int) -> tuple[int, bytes]:
    """Ascending values >= base as gaps: quotients by 2**shift in unary, then the
    remainders at ``shift`` bits each."""
    gaps = np.diff(values, prepend=np.int64(base))
    mean = max(1.0, float(gaps.mean())) if len(gaps) else 1.0
    shift = max(0, int(math.log2(mean)))
    quotients = gaps >> shift
    stops = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(stops[-1]) + 1 if len(stops) else 0, dtype=np.uint8)
    unary[stops] = 0
    rest = ((gaps[:, None] >> np.arange(shift - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return shift, np.packbits(np.concatenate((unary, rest))).tobytes()


def golomb_decode(code: bytes, n: int, base: int, shift: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    stops = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    at = int(stops[-1]) + 1 if n else 0
    rest = bits[at : at + n * shift].reshape(n, shift).astype(np.int64) @ (1 << np.arange(shift - 1, -1, -1, dtype=np.int64))
    return base + np.cumsum((quotients << shift) + rest)


def _flush(ids: list, shas: list, block: int, owner_bits: int):
    digest = np.frombuffer(b"".join(shas), dtype=">u8").reshape(-1, 4)[:, 0]
    prints = (digest >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.int64)
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    owners = prints >> (FINGERPRINT_BITS - owner_bits)
    edges = np.flatnonzero(np.diff(owners, prepend=-1))
    out = {k: [] for k in ("block", "owner", "base", "shift", "n", "codes", "repeated", "rows", "ids", "shas")}
    for a, b in zip(edges, np.append(edges[1:], len(prints))):
        owner = int(owners[a])
        values, rows = np.unique(prints[a:b], return_counts=True)
        base = owner << (FINGERPRINT_BITS - owner_bits)
        shift, code = golomb_encode(values, base)
        for k, v in (("block", block), ("owner", owner), ("base", base), ("shift", shift), ("n", len(values)), ("codes", code), ("repeated", np.packbits(rows > 1).tobytes()), ("rows", rows.tolist()), ("ids", [ids[i] for i in order[a:b]]), ("shas", b"".join([shas[i] for i in order[a:b]]))):
            out[k].append(v)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def _digests(col: pa.Array) -> list[bytes]:
    """SHA-256 of each text, A-Z lower-cased; null counts as empty."""
    data, offs = common.text_buffer(col)
    view = memoryview(data)
    return [hashlib.sha256(bytes(view[a:b]).lower()).digest() for a, b in zip(offs[:-1], offs[1:])]


def _blocks(batches, owner_bits):
    ids, shas, seq = [], [], TaskContext.get().partitionId() << 32
    for batch in batches:
        shas += _digests(batch["text"])
        ids += batch["doc_id"].to_pylist()
        if len(ids) >= BLOCK_ROWS:
            yield _flush(ids, shas, seq, owner_bits)
            ids, shas, seq = [], [], seq + 1
    if ids:
        yield _flush(ids, shas, seq, owner_bits)


def _answer(table: pa.Table) -> pa.Table:
    """An owner's reply: of each block's fingerprints, which another block has."""
    cols = table.select(["codes", "n", "base", "shift"]).to_pylist()
    parts = [golomb_decode(x["codes"], x["n"], x["base"], x["shift"]) for x in cols]
    values, times = np.unique(np.concatenate(parts), return_counts=True)
    shared = values[times > 1]
    return pa.table({"block": table["block"], "owner": table["owner"], "hits": pa.array([np.packbits(np.isin(p, shared)).tobytes() for p in parts], pa.binary())})


def _marks(batches):
    for batch in batches:
        for x in batch.to_pylist():
            hit = np.unpackbits(np.frombuffer(x["hits"], np.uint8) | np.frombuffer(x["repeated"], np.uint8))[: x["n"]]
            suspect = np.repeat(hit.astype(bool), x["rows"])
            shas = pa.Array.from_buffers(pa.binary(32), len(suspect), [None, pa.py_buffer(x["shas"])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x["ids"], pa.int64()), shas, pa.array(suspect)], names=["doc_id", "sha", "suspect"])


def _probes(shas: list[bytes], bits: int) -> np.ndarray:
    """The filter's bits of each digest, one row a probe."""
    h = np.frombuffer(b"".join(shas), dtype="<u8").reshape(-1, 4)
    return np.stack([(h[:, 1] + np.uint64(k) * (h[:, 2] | np.uint64(1))) % np.uint64(bits) for k in range(PROBES)])


def _set_bits(batches, bits):
    """(word, bits set in it) of the filter, one row a word and batch."""
    for batch in batches:
        if batch.num_rows:
            at = _probes(batch["sha"].to_pylist(), bits).ravel()
            words, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(words), dtype=np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])


def _passing(batches, words, bits):
    """The rows whose digest the filter holds."""
    for batch in batches:
        if batch.num_rows:
            at = _probes(_digests(batch["text"]), bits)
            hit = (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(hit.all(axis=0)))


def _suspects(rows: DataFrame, marks: DataFrame, count: int) -> DataFrame:
    """The suspects among ``rows``, and about one in a hundred of the others."""
    bits = min(MOST_BITS, max(64, -(-BITS_EACH * count // 64) * 64))
    found = marks.where("suspect").select("sha").mapInArrow(lambda it: _set_bits(it, bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return rows.mapInArrow(lambda it: _passing(it, words, bits), "doc_id long, text string")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept,
    text_sha256 (of the text with A-Z lower-cased).

    Null counts as the empty text.  Of equal texts the largest doc_id stays; null ids
    rank below all others, and of rows alike in text and id exactly one has kept =
    true.  group_size counts rows, repeated ones too.  Other columns are not read; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    owners = max(4 * common.shuffle_partitions(spark), docs.count() / OWNED)
    owner_bits = max(1, math.ceil(math.log2(owners)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = common.materialize(rows.mapInArrow(lambda it: _blocks(it, owner_bits), _BLOCK), "fingerprints")
    answers = blocks.select("block", "owner", "base", "shift", "n", "codes").groupBy("owner").applyInArrow(_answer, "block long, owner int, hits binary")
    back = blocks.select("block", "owner", "n", "repeated", "rows", "ids", "shas").join(answers, ["block", "owner"])
    marks = common.materialize(back.mapInArrow(_marks, "doc_id long, sha binary, suspect boolean"), "marks")

    count = marks.where("suspect").count()
    suspects = _suspects(rows, marks, count)
    groups = suspects.groupBy(common.lower_ascii(F.col("text")).alias("norm")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = common.materialize(groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "groups")
    alike = marks.where("suspect").groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    # Fewer than twice the partitions, each with more rows than half a partition's.
    large = F.broadcast(groups.where(F.col("group_size") > count / (2 * common.shuffle_partitions(spark))))
    rest = alike.join(large.select("sha"), "sha", "left_anti").join(groups.hint("merge"), "sha", "left")
    settled = common.repeated(alike.join(large, "sha").unionByName(rest), "times", "nth")
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    size = F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    settled = settled.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), size, (F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))).alias("kept"), sha)
    alone = marks.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return alone.unionByName(settled)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.documents(spark, sf_dir))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
