"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints within ``DISTANCE`` = 4 bits differ in at most four of their eight
bytes, so they share at least four bytes by position.  The index therefore posts each
distinct fingerprint under byte triples, ``TRIPLES``: any four positions contain one
of these twenty, so each such pair meets in a posting list.  Within a list the shared positional bytes of
a pair are tallied, pairs that reach four are kept, and their bits are compared.

Only what connects a list's fingerprints leaves it (a spanning forest of its links),
so a large group of near copies gives rows in proportion to its size.  Lists are
dealt by range over (list, fingerprint); a list that touches a task's edge or is too
long for one task is compared block by block, each pair of blocks a task's work.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE, SEED, DISTANCE, SHARED = 4, 42, 4, 4
#: A list longer than this is compared by pairs of blocks of about this many.
BLOCK = 4096
_SMALL = 12


def _cover() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that every four positions contain one: the
    positions in three classes, two of a class with one of the next, or all three."""
    classes = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [t for c in classes for t in combinations(c, 3)]
    for i, c in enumerate(classes):
        found += [tuple(sorted((*pair, one))) for pair in combinations(c, 2) for one in classes[(i + 1) % 3]]
    return found


TRIPLES = _cover()


def fingerprint(text: bytes) -> int:
    """64-bit SimHash over the XXH64 values of a text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[: len(words) - SHINGLE] + 1)).tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    digest, n, ones = xxhash.xxh64_intdigest, len(begins), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + (1 << 16)], ends[at : at + (1 << 16)])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        view = memoryview(data)
        prints = np.array([fingerprint(bytes(view[a:b])) for a, b in zip(offs[:-1], offs[1:])], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; null text has no words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _postings(batches):
    for batch in batches:
        fp = batch["fp"].to_numpy().view(np.uint64)
        octets = [(fp >> np.uint64(8 * p)) & np.uint64(255) for p in range(8)]
        for k, (a, b, c) in enumerate(TRIPLES):
            key = (np.uint64(k) << np.uint64(24)) | (octets[a] << np.uint64(16)) | (octets[b] << np.uint64(8)) | octets[c]
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), batch["fp"]], names=["list", "fp"])


def _linked(x: np.ndarray) -> np.ndarray:
    """Of XORed pairs: tally the shared positional bytes, then verify the bits."""
    near = np.zeros(len(x), dtype=bool)
    tally = np.zeros(len(x), dtype=np.int8)
    for p in range(8):
        tally += (x & np.uint64(255 << (8 * p))) == 0
    kept = np.flatnonzero(tally >= SHARED)
    near[kept] = np.bitwise_count(x[kept]) <= DISTANCE
    return near


def _forest(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links among ``a`` (or between a and b) connect."""
    nodes = a if b is None else np.concatenate((a, b))
    side = np.zeros(len(nodes), dtype=np.int8)
    if b is not None:
        side[len(a) :] = 1
    rest, us, vs = np.arange(len(nodes)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = _linked(nodes[rest] ^ nodes[i])
            if b is not None:
                hit &= side[rest] != side[i]
            if hit.any():
                got = rest[hit]
                us += [i] * len(got)
                vs += got.tolist()
                queue += got.tolist()
                rest = rest[~hit]
    return nodes[np.array(us, np.int64)], nodes[np.array(vs, np.int64)]


def _pairs(u: np.ndarray, v: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["kind", "u", "v"])


def _links(batch: pa.RecordBatch):
    """Links within the lists of a batch that holds whole lists, in order."""
    key, fp = batch["list"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
    edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    sizes = np.diff(np.append(edges, len(key)))
    small = np.repeat(sizes <= _SMALL, sizes)
    for d in range(1, min(_SMALL, len(key))):
        at = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if not len(at):
            break
        near = at[_linked(fp[at] ^ fp[at + d])]
        yield _pairs(fp[near], fp[near + d], 0)
    for a, n in zip(edges[sizes > _SMALL], sizes[sizes > _SMALL]):
        yield _pairs(*_forest(fp[a : a + n]), 0)


def _compared(batches):
    """kind 0: a link (u, v).  kind 1: fingerprint v of a list u still to be compared,
    one at the edge of this task or longer than a block."""
    edge, held, over = None, None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = None
        key = batch["list"].to_numpy()
        edge = key[0] if edge is None else edge
        cut = int(np.searchsorted(key, key[-1]))
        head, tail = batch.slice(0, cut), batch.slice(cut)
        if cut:
            loose = (key[:cut] == edge) | (key[:cut] == (edge if over is None else over))
            if loose.any():
                yield _pairs(key[:cut][loose].view(np.uint64), head["fp"].to_numpy()[loose].view(np.uint64), 1)
            if not loose.all():
                yield from _links(head.filter(pa.array(~loose)))
        if key[-1] in (edge, over) or tail.num_rows > BLOCK:
            over = key[-1] if tail.num_rows > BLOCK else over
            yield _pairs(key[cut:].view(np.uint64), tail["fp"].to_numpy().view(np.uint64), 1)
        else:
            held = tail
    if held is not None:
        yield _pairs(held["list"].to_numpy().view(np.uint64), held["fp"].to_numpy().view(np.uint64), 1)


def _block_pair(table: pa.Table) -> pa.Table:
    fp, block = table["fp"].to_numpy().view(np.uint64), table["block"].to_numpy()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    u, v = _forest(fp) if i == j else _forest(fp[block == i], fp[block == j])
    return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})


def links(distinct: DataFrame) -> DataFrame:
    """(fp) distinct -> (u, v) links that connect all fingerprints within DISTANCE."""
    spark = distinct.sparkSession
    parts = 2 * common.shuffle_partitions(spark)
    posted = distinct.select("fp").mapInArrow(_postings, "list long, fp long")
    found = common.materialize(posted.repartitionByRange(parts, "list", "fp").sortWithinPartitions("list", "fp").mapInArrow(_compared, "kind int, u long, v long"), "links")
    loose = found.where("kind = 1").select(F.col("u").alias("list"), F.col("v").alias("fp"))
    blocks = loose.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = loose.join(blocks.hint("merge"), "list").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    rest = dealt.groupBy("list", "i", "j").applyInArrow(_block_pair, "u long, v long")
    return found.where("kind = 0").select("u", "v").unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    Null or empty texts have fingerprint zero and link like any other.  component_id
    is the least doc_id reachable over links of at most DISTANCE bits; null ids do
    not count, and it is null where no other id is reachable.  Rows that repeat a
    doc_id are told apart by their fingerprints.  Other columns are not read.  An
    empty table gives an empty result.
    """
    prints = common.materialize(fingerprints(docs), "simhash")
    nodes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("times")), "nodes")
    total, distinct = nodes.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count(F.lit(1))).first()
    found = connected_components(links(nodes)).withColumnRenamed("node", "fp")
    nodes = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    nodes = common.materialize(nodes, "linked")
    named = common.materialize(nodes.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "components")
    nodes = common.met(nodes, named, "component", "members", distinct).select("fp", "times", "component_id")
    return common.met(prints, nodes, "fp", "times", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
