"""Shared pieces of the corpus operators: scratch tables, Arrow text access and
vectorised word hashing.

Scratch tables go below the folder the cluster names in ``spark.checkpoint.dir``.  A
machine-local folder is only taken where that setting is absent and Spark runs in one
process; on a cluster its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of ``[^\x20\x09-\x0D]+``: space and the five controls 0x09-0x0D.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True

REPEATED = 1000

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_R = 0xD6E8FEB86659FD93


def scratch_root(spark: SparkSession) -> str:
    """Folder for scratch tables that driver and executors both reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = "file://" + os.path.join(tempfile.gettempdir(), "faremill-scratch")
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: scratch tables need a folder that driver and executors share")
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts the lineage, and
    survives the loss of executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/faremill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def repeated(df: DataFrame, times: str, nth: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1 by ``nth``; in two steps, so that no
    array is as long as a row is frequent."""
    n = F.col(times)
    steps = df.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(REPEATED).cast("long"))))
    return steps.withColumn(nth, F.explode(F.sequence(F.col("_at") + 1, F.least(F.col("_at") + REPEATED, n)))).drop("_at")


def met(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to their ``groups``, one row a key with its number of rows in
    ``size``; ``total``: rows in all.  Groups larger than half an average partition are
    fewer than twice the partitions, so these are broadcast, and the others shuffled."""
    most = total / (2 * shuffle_partitions(rows.sparkSession))
    large = F.broadcast(groups.where(F.col(size) > most))
    rest = rows.join(large.select(key), key, "left_anti").join(groups.where(F.col(size) <= most).hint("merge"), key)
    return rows.join(large, key).unionByName(rest)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def row_chunks(offs: np.ndarray, most: int = 1 << 20):
    """Row ranges of at most ``most`` bytes each (one row at least)."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of the words in rows of ``data``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_IS_SPACE[data]
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = solid
    before[offs] = False
    starts = np.flatnonzero(solid & ~before[:n])
    after = np.empty(n + 1, dtype=bool)
    after[:n] = solid
    after[n] = False
    after[offs] = False
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


_LANE = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step over all spans together."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    h = mix64((lanes[starts] & _LANE[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _GOLD))
    at, left, rows = starts + 8, size - 8, None
    more = np.flatnonzero(left > 0)
    rows, at, left = more, at[more], left[more]
    while len(rows):
        h[rows] = mix64(h[rows] ^ ((lanes[at] & _LANE[np.minimum(left, 8)]) + _GOLD))
        at, left = at + 8, left - 8
        keep = left > 0
        if not keep.all():
            rows, at, left = rows[keep], at[keep], left[keep]
    return h


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (mixed)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, span, size = None, 0, h, 1, 1
    need = k
    while need:
        if need & 1:
            part = power[done : done + n] if out is not None else power[:n]
            factor = np.uint64(pow(_R, done, 1 << 64))
            out = part.copy() if out is None else out + factor * part
            done += size
        need >>= 1
        if need:
            factor = np.uint64(pow(_R, size, 1 << 64))
            power = power[: len(power) - size] + factor * power[size:]
            size *= 2
    return mix64(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every run of ``k`` values."""
    n = len(x) - k + 1
    if n <= 0:
        return x[:0]
    size = 1
    while size * 2 <= k:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[k - size : k - size + n])
