"""Compression of vectors to codes: one codebook a part position, found through trees.

A vector's components become integers, its equal parts are replaced by the index of the
nearest codebook entry.  A codebook is learned by rounds over all vectors: each task
assigns its parts and emits sums and counts an entry, Spark adds these up, and the
entries (parts times entries, a few thousand numbers whatever the rows) go back to the
tasks.  Within a task the nearest entry is found in a vantage-point tree of the
position's entries, by branch and bound:

* a node's vantage is an entry; its two children are the nearer and the farther half of
  the rest, each with the least and the largest distance to the vantage, rounded down
  and up to integers;
* a first descent along the nearer side sets a bound for every query;
* then every node is met once, with the queries that may still find an entry there: a
  child is left out only if the distance that the triangle inequality leaves, rounded
  down, is larger than the best one.  Equal distances are visited, as the entry of the
  lower index must win;
* distances that count are squared ones of integers, so they are exact.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 4
#: Rows that a task takes at a time; components are refused beyond the bound, below
#: which squares and a task's sums are exact in 64 bits.
BLOCK, MOST = 1 << 16, 1 << 24


def _above(square: int) -> int:
    """The root of a square, rounded up."""
    root = math.isqrt(square)
    return root + (root * root < square)


class Tree:
    """A vantage-point tree over the rows of an integer matrix.

    Node k has an entry ``vantage[k]``, or is a leaf with several; ``child[k]`` holds its
    halves as (node, least distance, largest distance) to its vantage."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.vantage: list[int] = []
        self.leaf: list[np.ndarray | None] = []
        self.child: list[tuple] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, rows: np.ndarray) -> int:
        k = len(self.vantage)
        self.vantage.append(int(rows[0])), self.leaf.append(rows), self.child.append(())
        if len(rows) <= LEAF:
            return k
        apart = ((self.entries[rows][:, None] - self.entries[rows][None]) ** 2).sum(2)
        top = int(np.argmax(np.sqrt(apart).std(1)))  # the entry that tells the others apart best
        order = np.argsort(apart[top], kind="stable")
        order = order[order != top]
        halves = order[: len(order) // 2], order[len(order) // 2 :]
        self.vantage[k], self.leaf[k] = int(rows[top]), None
        self.child[k] = tuple((self._grow(rows[h]), math.isqrt(int(apart[top, h].min())), _above(int(apart[top, h].max()))) for h in halves)
        return k

    def _meet(self, k: int, x: np.ndarray, at: np.ndarray, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Compares the queries ``at`` with the node's entry; their squared distances."""
        square = ((x[at] - self.entries[self.vantage[k]]) ** 2).sum(1)
        self._take(square, self.vantage[k], at, best, who)
        return square

    def _take(self, square, entry, at, best, who) -> None:
        better = (square < best[at]) | ((square == best[at]) & (entry < who[at]))
        best[at[better]], who[at[better]] = square[better], entry

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row (the lowest on a tie), and its square."""
        n = len(x)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.entries), dtype=np.int64)
        self._descend(x, best, who)
        stack = [(0, np.arange(n))]
        while stack:
            k, at = stack.pop()
            if self.leaf[k] is not None:
                for entry in self.leaf[k]:
                    self._take(((x[at] - self.entries[entry]) ** 2).sum(1), int(entry), at, best, who)
                continue
            square = self._meet(k, x, at, best, who)
            root = np.sqrt(square.astype(np.float64)).astype(np.int64)  # within one of the root
            low, high = np.maximum(root - 1, 0), root + 2
            for node, least, largest in self.child[k]:
                gap = np.maximum(np.maximum(least - high, low - largest), 0)
                may = at[gap * gap <= best[at]]
                if len(may):
                    stack.append((node, may))
        return who, best

    def _descend(self, x, best, who) -> None:
        """Follows each query's nearer half down to a leaf."""
        ways = [(0, np.arange(len(x)))]
        while ways:
            k, at = ways.pop()
            square = self._meet(k, x, at, best, who)
            if self.leaf[k] is None:
                (a, _, a_most), (b, b_least, _) = self.child[k]
                nearer = np.sqrt(square.astype(np.float64)) <= (a_most + b_least) / 2
                ways += [(node, at[m]) for node, m in ((a, nearer), (b, ~nearer)) if m.any()]


def integers(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are whole and finite, and their components as integers,
    rounded down."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pa.compute.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.zeros(len(size), dtype=np.int64)
    np.add.at(bad, np.repeat(np.arange(len(size)), size)[~np.isfinite(values)], 1)
    kept = (size > 0) & (bad == 0)
    widths = np.unique(size[kept])
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {widths.tolist()}")
    x = np.floor(values[np.repeat(kept, size)] * scale)
    if x.size and np.abs(x).max() > MOST:
        raise ValueError(f"a component beyond {MOST // scale} in size")
    return np.flatnonzero(kept), x.astype(np.int64).reshape(len(np.flatnonzero(kept)), widths[0] if len(widths) else 0)


def blocks(batches):
    """Record batches, put together to some 65,536 rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def trees(books: list[np.ndarray]) -> list[Tree]:
    return [Tree(b) for b in books]


def assigned(x: np.ndarray, forest: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column a part."""
    width = forest[0].entries.shape[1]
    if x.shape[1] != width * len(forest):
        raise ValueError("vectors of different lengths")
    found = [t.nearest(x[:, k * width : (k + 1) * width]) for k, t in enumerate(forest)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _first(rows: DataFrame, entries: int, scale: int) -> np.ndarray:
    """Integer vectors of the smallest ids; as many as a codebook has entries."""

    def decoded(batches):
        for t in blocks(batches):
            at, x = integers(t["embedding"], scale)
            yield pa.RecordBatch.from_arrays([t["vec_id"].combine_chunks().take(pa.array(at)), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["vec_id", "x"])

    firsts = rows.select("vec_id", "embedding").mapInArrow(decoded, "vec_id long, x array<long>").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if len({len(r.x) for r in firsts}) > 1:
        raise ValueError("vectors of different lengths")
    return np.array([r.x for r in firsts], dtype=np.int64)


def _learned(rows: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """One round: every part to its nearest entry, every entry to its parts' mean."""
    width = books[0].shape[1]

    def sums(batches):
        forest = trees(books)
        total = np.zeros((len(books), len(books[0]), width + 1), dtype=np.int64)
        for t in blocks(batches):
            _, x = integers(t["embedding"], scale)
            if len(x):
                codes, _ = assigned(x, forest)
                for k in range(len(books)):
                    for j in range(width + 1):  # weights stay below 2^53, so these sums are exact
                        weights = x[:, k * width + j] if j < width else None
                        total[k, :, j] += np.bincount(codes[:, k], weights, minlength=len(books[0])).astype(np.int64)
        part, entry = np.nonzero(total[:, :, width])
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    each = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width + 1)]
    out = [b.copy() for b in books]
    for r in rows.select("embedding").mapInArrow(sums, "part long, entry long, sums array<long>").groupBy("part", "entry").agg(*each).collect():
        out[r.part][r.entry] = [int(r[f"s{j}"]) // int(r[f"s{width}"]) for j in range(width)]
    return out


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """(vec_id, embedding) -> one integer matrix a part position, an entry a row; none
    where no vector is kept.  A codebook begins as the part of the vectors of the smallest
    ids (nulls last, ties by their components), so with fewer vectors it has fewer."""
    first = _first(vectors, entries, scale)
    if not len(first):
        return []
    if first.shape[1] % parts:
        raise ValueError(f"{first.shape[1]} components are no {parts} equal parts")
    books = np.split(first, parts, axis=1)
    for _ in range(rounds):
        books = _learned(vectors, books, scale)
    return books


def coded(vectors: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, label, code (binary, a byte a part), error."""
    kind = vectors.schema["label"].dataType.simpleString()

    def code(batches):
        forest = trees(books)
        for t in blocks(batches):
            at, x = integers(t["embedding"], scale)
            if len(at):
                codes, squares = assigned(x, forest)
                raw = codes.astype(np.uint8).tobytes()
                take = lambda c: t[c].combine_chunks().take(pa.array(at))
                yield pa.RecordBatch.from_arrays([take("vec_id"), take("label"), pa.array([raw[i : i + len(books)] for i in range(0, len(raw), len(books))], pa.binary()), pa.array(squares.sum(1))], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(code, f"vec_id long, label {kind}, code binary, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, embedding, label) -> rows (vec_id, label, code, error, label_error), and
    the codebooks that decode them.

    Rows with a null vector, an empty one, or one with a null or non-finite component are
    dropped; vectors of different lengths, or components beyond 2^16, are an error.
    Repeated rows and ids stay; null ids count as the largest.  label_error is the error
    of all rows of a label, nulls together: labels are counted before they meet their
    rows, so a label with a third of all rows is one small row.  A table with nothing to
    keep gives no rows and no codebooks.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = codebooks(vectors, parts, entries, rounds, scale)
    rows = common.materialize(coded(vectors, books, scale).withColumn("name", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n"))), "codes")
    groups = common.materialize(rows.groupBy("name").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("members")), "labels")
    total = groups.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    return common.met(rows, groups, "name", "members", total).select("vec_id", "label", "code", "error", "label_error"), books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def decoded(codes: np.ndarray, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """Vectors that codes (a row each) stand for: the middle of each entry's cell."""
    return (np.concatenate([b[codes[:, k]] for k, b in enumerate(books)], axis=1) + 0.5) / scale


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one assignment (a), and of the codebooks after it (b)."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT p.rid, p.part, min(list_sum(list_transform(list_zip(p.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 64 + b.e) AS m FROM p JOIN b{k} b ON p.part = b.part GROUP BY p.rid, p.part
), b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(n.q, b.q) AS q FROM b{k} b LEFT JOIN (
    SELECT part, e, list(CAST(floor(s / c) AS BIGINT) ORDER BY j) AS q FROM (
      SELECT p.part, CAST(a.m % 64 AS BIGINT) AS e, j, sum(p.q[j + 1]) AS s, count(*) AS c FROM a{k} a JOIN p ON a.rid = p.rid AND a.part = p.part, range((SELECT max(len(q)) FROM p)) t(j) GROUP BY ALL
    ) GROUP BY part, e
  ) n ON n.part = b.part AND n.e = b.e
)"""


OP12_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, part, list_slice(v, part * (len(v) // 16) + 1, (part + 1) * (len(v) // 16)) AS q FROM k, range(16) t(part)
), b0 AS MATERIALIZED (
  SELECT p.part, f.e, p.q FROM (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM k) f JOIN p ON p.rid = f.rid WHERE f.e < 64
),{_round(0)},{_round(1)},
a2 AS (
  SELECT p.rid, p.part, min(list_sum(list_transform(list_zip(p.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 64 + b.e) AS m FROM p JOIN b2 b ON p.part = b.part GROUP BY p.rid, p.part
), c AS (
  SELECT rid, string_agg(lower(printf('%02x', CAST(m % 64 AS BIGINT))), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY rid
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
FROM k JOIN c ON c.rid = k.rid
"""
