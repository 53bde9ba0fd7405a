"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors x, y of cosine c have projections on a Gaussian direction that are
bivariate normal with correlation c, whatever the number of dimensions.

1. Candidates.  In each of L tables a vector is dealt to a bucket by which side of
   ``k`` of the ``SIDES`` directions it lies on.  What travels is its number, its sides
   and the cells of its projections, 64 bytes, not the vector.  A bucket is sorted along
   the table's lead projection, and a query meets the vectors in the window of
   ``WINDOW`` cells on each side of it.
2. Counting.  Of a pair that meets, the projections are counted in which one vector
   falls into the window around the other.  A bucket returns which of its vectors have a
   partner that reaches ``least_count``; only these go on, with their vectors.
3. Verification, in double precision.  The bucket counts again among them and compares
   the pairs that pass.  A pair that meets in several tables counts in the first of
   them only; of a pair's earlier tables one in five has met it, so few are looked at.

k grows with the logarithm of the number of distinct vectors, so that a bucket holds
about ``PARTNERS`` of them; L and the least count are calibrated (``tables``,
``least_count``) so that a pair at the threshold is found with probability ``RECALL``,
and a closer one more often.  Buckets longer than ``BLOCK`` are compared by pairs of
blocks.  Equal vectors are collapsed first and count by their number.  A bucket
returns link counts and a spanning star of each of its groups, not its pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

COSINE, RECALL = 0.9, 0.998
PROJECTIONS, CELL, WINDOW, SIDES, RANDOM = 40, 1 / 16, 16, 128, 911
PARTNERS, BLOCK, QUERIES = 1024, 4096, 256
#: Columns of 64 sides each.
WORDS = [f"s{k}" for k in range(SIDES // 64)]
#: More long buckets than this are told by a shuffle, not a broadcast.
MOST_LONG = 100_000


def _both(c: float) -> float:
    """The recall of each of the two filters, count and tables."""
    return math.sqrt(c)


def least_count(cosine: float = COSINE, recall: float = RECALL) -> int:
    p = math.erf(WINDOW * CELL / math.sqrt(2 - 2 * cosine) / math.sqrt(2))
    tail, t = 0.0, PROJECTIONS + 1
    while tail < _both(recall):
        t -= 1
        tail += math.comb(PROJECTIONS, t) * p**t * (1 - p) ** (PROJECTIONS - t)
    return t


@lru_cache(maxsize=8)
def _directions(dims: int) -> np.ndarray:
    return np.random.default_rng(RANDOM).normal(size=(dims, PROJECTIONS + SIDES))


@lru_cache(maxsize=8)
def tables(k: int, cosine: float = COSINE, recall: float = RECALL) -> np.ndarray:
    """The sides that each table reads, one row of k numbers a table: as many tables
    as simulated pairs at the threshold need to meet in one."""
    if k == 0:
        return np.zeros((1, 0), dtype=np.int64)
    rng = np.random.default_rng(RANDOM)
    x = rng.normal(size=(20_000, PROJECTIONS + SIDES))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.normal(size=x.shape)
    near = np.abs(x - y)[:, :PROJECTIONS] <= (WINDOW - 1) * CELL
    same = (x > 0)[:, PROJECTIONS:] == (y > 0)[:, PROJECTIONS:]
    found, out = np.zeros(len(x), dtype=bool), []
    while found.mean() < _both(recall):
        sides = rng.choice(SIDES, size=k, replace=False)
        found |= near[:, len(out) % PROJECTIONS] & same[:, sides].all(axis=1)
        out.append(sides)
    return np.array(out)


def _masks(sides: np.ndarray) -> np.ndarray:
    """Tables as 64-bit masks over the sides, one a word."""
    out = np.zeros((len(sides), len(WORDS)), dtype=np.uint64)
    for t, row in enumerate(sides):
        for x in row:
            out[t, x // 64] |= np.uint64(1) << np.uint64(x % 64)
    return out


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of lists of one length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _sided(batches):
    """The cells of each vector's projections, a byte each, and its sides as 64-bit words."""
    for batch in batches:
        dims, words = batch["dims"].to_numpy(), np.zeros((batch.num_rows, len(WORDS)), dtype=np.uint64)
        cells = np.zeros((batch.num_rows, PROJECTIONS), dtype=np.uint8)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            along = _matrix(batch["vector"].take(pa.array(at))) @ _directions(int(d))
            words[at] = np.packbits(along[:, PROJECTIONS:] > 0, axis=1, bitorder="little").view("<u8")
            cells[at] = np.clip(np.floor(along[:, :PROJECTIONS] / CELL) + 128, 0, 255)
        packed = pa.array([c.tobytes() for c in cells], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, packed, *[pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(len(WORDS))]], names=[*batch.schema.names, "cells", *WORDS])


def _meeting(ca: np.ndarray, cb: np.ndarray, lead: int, same: bool, least: int):
    """Index pairs that fall into each other's lead window and whose window collisions
    reach ``least``; ca, cb: cells, one row a projection, sorted by the lead's."""
    for at in range(0, ca.shape[1], QUERIES):
        q = ca[:, at : at + QUERIES]
        lo = int(np.searchsorted(cb[lead], max(0, int(q[lead, 0]) - WINDOW)))
        hi = int(np.searchsorted(cb[lead], min(255, int(q[lead, -1]) + WINDOW), side="right"))
        tally = np.zeros((q.shape[1], hi - lo), dtype=np.uint8)
        gap = np.empty_like(tally)
        for p in (lead, *[p for p in range(PROJECTIONS) if p != lead]):
            # |cell - query cell| <= WINDOW as one unsigned comparison
            np.subtract(cb[p, lo:hi][None, :], (q[p].astype(np.int16) - WINDOW).astype(np.uint8)[:, None], out=gap)
            if p == lead:
                inside = gap <= 2 * WINDOW
            tally += gap <= 2 * WINDOW
        u, v = np.nonzero((tally >= least) & inside)
        u, v = u + at, v + lo
        if same:
            u, v = u[u < v], v[u < v]
        yield u, v


def _sorted(table: pa.Table):
    """A task's rows along its table's lead: order, cells (a row a projection), the lead,
    and the places of either block."""
    lead = table["t"][0].as_py() % PROJECTIONS
    cells = np.frombuffer(b"".join(table["cells"].to_pylist()), dtype=np.uint8).reshape(-1, PROJECTIONS)
    order = np.argsort(cells[:, lead], kind="stable")
    block = table["block"].to_numpy()[order]
    return order, np.ascontiguousarray(cells[order].T), lead, np.flatnonzero(block == table["i"][0].as_py()), np.flatnonzero(block == table["j"][0].as_py())


def _met(table: pa.Table, least: int) -> pa.Table:
    """The rows of a task that have a partner of enough collisions."""
    table = table.combine_chunks()
    order, cells, lead, mine, other = _sorted(table)
    hit = np.zeros(len(order), dtype=bool)
    for u, v in _meeting(cells[:, mine], cells[:, other], lead, table["i"][0] == table["j"][0], least):
        hit[mine[u]] = hit[other[v]] = True
    return table.take(pa.array(np.sort(order[hit])))


def _bucket(table: pa.Table, cosine: float, least: int, masks: np.ndarray) -> pa.Table:
    table = table.combine_chunks()
    t = table["t"][0].as_py()
    order, cells, lead, mine, other = _sorted(table)
    vectors = _matrix(table["vector"])[order]
    node, times = (table[c].to_numpy()[order] for c in ("node", "times"))
    sides = np.stack([table[c].to_numpy()[order] for c in WORDS], axis=1).view(np.uint64)
    label, count = np.arange(len(node)), np.zeros(len(node), np.int64)
    us, vs = [], []
    for u, v in _meeting(cells[:, mine], cells[:, other], lead, table["i"][0] == table["j"][0], least):
        for at in range(0, len(u), 1 << 16):
            x, y = mine[u[at : at + (1 << 16)]], other[v[at : at + (1 << 16)]]
            near = np.einsum("nd,nd->n", vectors[x], vectors[y]) >= cosine
            x, y = x[near], y[near]
            differ = sides[x] ^ sides[y]
            fresh = ~(differ & masks[t]).any(axis=1)
            for e in range(t + 1):
                x, y, differ = x[fresh], y[fresh], differ[fresh]
                if e == t or not len(x):
                    break
                p = e % PROJECTIONS
                fresh = (differ & masks[e]).any(axis=1) | (np.abs(cells[p, x].astype(np.int16) - cells[p, y]) > WINDOW)
            np.add.at(count, x, times[y])
            np.add.at(count, y, times[x])
            us.append(x)
            vs.append(y)
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        while True:
            low = np.minimum(label[u], label[v])
            before = label.copy()
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
            label = label[label]
            if (label == before).all():
                break
    some = count > 0
    return pa.table({"node": pa.array(node[some]), "root": pa.array(node[label[some]]), "links": pa.array(count[some])})


def buckets(distinct: DataFrame, masks: np.ndarray) -> DataFrame:
    """Each vector's number, sides and cells in its bucket of each table; t, bucket, i
    and j name a task's work: a whole bucket, or a pair of blocks of a long one."""
    read = F.array(*[F.struct(F.lit(t).alias("t"), *[F.lit(int(m)).alias(w) for m, w in zip(row, WORDS)]) for t, row in enumerate(masks.view(np.int64))])
    rows = distinct.withColumn("m", F.explode(read)).withColumn("bucket", F.xxhash64(*[F.col(w).bitwiseAND(F.col(f"m.{w}")) for w in WORDS]))
    rows = rows.select("node", "times", "cells", "dims", *WORDS, F.col("m.t").alias("t"), "bucket")
    key = ["dims", "t", "bucket"]
    long = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    long = common.materialize(long.select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "long-buckets")
    told = rows.join(F.broadcast(long) if long.count() <= MOST_LONG else long.hint("merge"), key, "left")
    told = told.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    told = told.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return told.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with", "blocks")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing, and so do vectors of different lengths with each other.  Repeated
    rows link like any other equal vectors.  A null vec_id counts as a link but never
    as a component's id; a component of null ids alone has a null id and is not kept.
    Other columns are not read.  An empty table gives an empty result.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    raw = F.col("embedding").cast(kind)
    finite = F.forall(raw, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # nan is greater
    sound = F.coalesce(finite & F.exists(raw, lambda x: x != 0), F.lit(False))
    units = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, raw).alias("vector"))
    distinct = units.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("times"))
    distinct = distinct.withColumns({"node": F.monotonically_increasing_id(), "dims": F.size("vector")})
    distinct = common.materialize(distinct.mapInArrow(_sided, f"vector {kind}, least_id long, times long, node long, dims int, cells binary, " + ", ".join(f"{w} long" for w in WORDS)), "vectors")
    rows, n = distinct.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count(F.lit(1))).first()
    masks, least = _masks(tables(max(0, math.ceil(math.log2(max(1, n) / PARTNERS))), cosine)), least_count(cosine)
    work = ["dims", "t", "bucket", "i", "j"]
    dealt = buckets(distinct, masks)
    met = common.materialize(dealt.groupBy(*work).applyInArrow(lambda b: _met(b, least), dealt.schema), "met")
    carried = met.join(distinct.select("node", "vector").hint("merge"), "node").groupBy(*work)
    found = common.materialize(carried.applyInArrow(lambda b: _bucket(b, cosine, least, masks), "node long, root long, links long"), "collisions")
    groups = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = distinct.select("node", "least_id", "times", "vector").join(groups, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = common.materialize(nodes, "linked")
    named = common.materialize(nodes.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "components")
    nodes = common.met(nodes, named, "component", "members", n).select("vector", "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = common.met(units.where("vector is not null"), nodes, "vector", "times", rows).select("vec_id", "n_links", "component_id")
    alone = units.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS u, vec_id AS r FROM v UNION SELECT links.w AS u, reach.r FROM reach JOIN links ON reach.u = links.u
), c AS (
  SELECT u, min(r) AS component_id FROM reach GROUP BY u
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.u = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.u
"""
