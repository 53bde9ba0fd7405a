"""Quality classifier: random Fourier features of document statistics, ridge from
partition-summed normal equations, then isotonic calibration.

Only statistics of the text enter a score.  Statistics are computed for every
document in one pass and kept as a narrow scratch table; each task of the training
rows adds up its part of the normal equations, whose size depends on the number of
features alone, and the driver solves their sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES, RIDGE, WIDTH, RANDOM = 256, 1e-3, 0.35, 20260
#: At most about this many labelled rows are used to fit, a fifth of them to calibrate.
MOST_LABELLED = 40_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "line": b"\n",
    "stop": b".,;:?'\"-()",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "high": bytes(range(128, 256)),
}
NAMES = ("log_words", "log_bytes", "word_bytes", "upper", "digit", "line", "stop", "shout", "bar", "symbol", "high", "shouted_words", "bare_words", "distinct_words", "distinct_pairs", "long_words", "short_words", "words_per_line")


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of NAMES for each row of a text buffer."""
    n_rows = len(offs) - 1
    table = {}
    for name, members in _CLASSES.items():
        mark = np.zeros(256, dtype=bool)
        mark[list(members)] = True
        total = np.concatenate(([0], np.cumsum(mark[data], dtype=np.int64)))
        table[name] = (total, np.diff(total[offs]).astype(float))
    starts, ends, first = common.word_spans(data, offs)
    h = common.hash_words(data, starts, ends)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    size = np.diff(offs).astype(float)
    solid = np.bincount(row, weights=(ends - starts), minlength=n_rows)
    letters = table["lower"][1] + table["upper"][1]
    per = lambda x, y: x / np.maximum(y, 1)
    length = ends - starts
    count = lambda mask: np.bincount(row[mask], minlength=n_rows) / some
    upper, lower = table["upper"][0], table["lower"][0]
    shouted = (upper[ends] - upper[starts] > 1) & (lower[ends] == lower[starts])
    odd = sum(table[k][0][ends] - table[k][0][starts] for k in ("shout", "bar", "symbol"))
    salt = common.mix64(np.arange(n_rows, dtype=np.uint64) + np.uint64(1))

    def distinct(x, rows):
        _, at = np.unique(x ^ salt[rows], return_index=True)
        return np.bincount(rows[at], minlength=n_rows)

    pairs = common.rolling(h, 2)
    inside = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
    cols = [
        np.log1p(words), np.log1p(size), per(solid, words), per(table["upper"][1], letters), per(table["digit"][1], solid), per(table["line"][1], words), per(table["stop"][1], words),
        per(table["shout"][1], words), per(table["bar"][1], words), per(table["symbol"][1], words), per(table["high"][1], solid), count(shouted), count(odd > 0),
        distinct(h, row) / some, per(distinct(pairs[inside], row[inside]), words - 1), count(length > 12), count(length < 4), np.log1p(per(words, table["line"][1] + 1)),
    ]
    return np.stack(cols, axis=1)


def _statistics(batches):
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        parts = [statistics(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in common.row_chunks(offs)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(bounds, pa.array(flat))], names=["doc_id", "stats"])


def _taught(batches):
    for batch in batches:
        (stats,) = _statistics([batch.select(["doc_id", "text"])])
        yield pa.RecordBatch.from_arrays([stats["stats"], batch["y"], batch["fits"]], names=["stats", "y", "fits"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) per row; null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, "doc_id long, stats array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].values.to_numpy()[: batch.num_rows * len(NAMES)].reshape(-1, len(NAMES)) if batch.num_rows else np.zeros((0, len(NAMES)))


def _phases(dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(RANDOM)
    return rng.normal(scale=WIDTH, size=(dims, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def _fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """cos(xW + b), whose products approximate a Gaussian kernel; and a constant."""
    w, b = _phases(x.shape[1])
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack((np.cos(z @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))))


def _equations(batches, mean, scale):
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for batch in batches:
        phi = _fourier(_matrix(batch), mean, scale)
        y = batch["y"].to_numpy().astype(float)
        total += phi.T @ np.hstack((phi, y[:, None]))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])


def _added(table: pa.Table) -> pa.Table:
    return pa.table({"i": table["i"][:1], "v": pa.array([np.sum(table["v"].to_pylist(), axis=0).tolist()], pa.list_(pa.float64()))})


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, value) of the ascending fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    # One pseudo-count keeps the ends off 0 and 1, without changing the order.
    knots = [(p, (s + 0.01) / (n + 0.02)) for s, n, lo, hi in blocks for p in ({lo, hi})]
    xs, vs = np.array(sorted(knots)).T
    return xs, np.maximum.accumulate(vs)


def _scores(batches, model):
    for batch in batches:
        if model is None:
            score = np.full(batch.num_rows, 0.5)
        else:
            mean, scale, weights, xs, vs = model
            score = np.interp(_fourier(_matrix(batch), mean, scale) @ weights, xs, vs)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.clip(score, 0, 1))], names=["doc_id", "score"])


def remainder(doc_id, folds: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def labelled(labels: DataFrame, column: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y) of the rows to learn from: one a document, at most about ``most``,
    picked by a hash of the id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))


def teachers(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y, fits): labelled rows to fit on, and a fifth to calibrate on."""
    return labelled(labels, "quality", FOLDS, HELD_OUT, most).withColumn("fits", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) > 0)


def fit(taught: DataFrame):
    """The model of (stats, y, fits), or None where there are no rows."""
    train = common.materialize(taught.select("stats", "y", "fits"), "training")
    moments = train.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not moments:
        return None
    mean = np.array([r["m"] for r in moments])
    scale = np.array([r["s"] if r["s"] > 1e-9 else 1.0 for r in moments])
    sums = train.where("fits").mapInArrow(lambda it: _equations(it, mean, scale), "i int, v array<double>").groupBy("i").applyInArrow(_added, "i int, v array<double>").collect()
    if not sums:
        return None
    system = np.array([r["v"] for r in sorted(sums)])
    n = system[-1, -2]
    weights = np.linalg.solve(system[:, :-1] + RIDGE * max(1.0, n) * np.diag([1.0] * FEATURES + [1e-6]) / FEATURES + 1e-9 * np.eye(FEATURES + 1), system[:, -1])
    check = train.where("not fits").select("stats", "y").toArrow()
    if check.num_rows < 20:
        check = train.select("stats", "y").toArrow()
    raw = np.concatenate([_fourier(_matrix(b), mean, scale) @ weights for b in check.combine_chunks().to_batches()])
    xs, vs = isotonic(raw, check["y"].to_numpy().astype(float))
    return mean, scale, weights, xs, vs


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` (doc_id, quality) teaches by the rows outside the held-out fold; null
    labels and ids teach nothing, of repeated labels the larger counts.  Null and
    empty texts are scored by their statistics, all zero.  A null doc_id counts as
    held out.  Repeated rows are scored alike.  Other columns are not read.  Without
    any labelled row every score is 0.5.  An empty table gives an empty result.
    """
    stats = common.materialize(document_statistics(docs), "statistics")
    model = fit(stats.join(teachers(labels, most), "doc_id"))
    scored = stats.mapInArrow(lambda it: _scores(it, model), "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _passed(batches, model):
    """The rows whose text scores THRESHOLD or more, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = common.text_buffer(batch["text"])
        mean, scale, weights, xs, vs = model
        keep = np.zeros(batch.num_rows, dtype=bool)
        for a, b in common.row_chunks(offs):
            stats = statistics(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            keep[a:b] = np.interp(_fourier(stats, mean, scale) @ weights, xs, vs) >= THRESHOLD
        yield batch.filter(pa.array(keep))


def of_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of ``docs`` that quality_scores would predict to be of quality, with
    all their columns; every row where no labelled row is found."""
    ids = F.broadcast(teachers(labels, most))  # about ``most`` ids
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    stats = known.mapInArrow(_taught, "stats array<double>, y int, fits boolean")
    model = fit(stats)
    return docs if model is None else docs.mapInArrow(lambda it: _passed(it, model), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
