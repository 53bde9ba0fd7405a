"""Toxicity by weak supervision.

1. Voters: a small general lexicon, address patterns, and words and word stems that
   the labelled rows single out; an automaton finds all of them in one pass.
   Voters that fire on nearly the same texts (a word and its stems) are merged first.
2. A generative label model: a latent label, and for every voter the rate at which it
   fires on either side of it, fitted by EM.  The given label is one more voter, with
   a reliability of its own to be estimated.  Voters that fire together beyond what
   the label explains are correlated, and share their weight.
3. A linear classifier on the voters' firing, trained on the posterior labels, which
   scores every text.

The label model and the classifier see a bounded sample of labelled rows
(``MOST_LABELLED``); counting and scoring are spread over tasks.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import labelled, remainder

#: At most about this many labelled rows teach.  Of the words and stems that qualify,
#: the strongest MOST_VOTERS are looked at (some 300 qualify in 3,000 labelled rows);
#: of those whose firing has a cosine of ALIKE or more, the strongest is a voter.
MOST_LABELLED, MOST_VOTERS, ALIKE = 12_000, 1_200, 0.9
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Lengths of the word stems that may become voters, and the least documents and
#: toxic share (smoothed) of one.
STEMS, LEAST_DOCS, LEAST_SHARE = range(3, 9), 4, 0.5
#: A general lexicon of insults; its voters take part whether or not labels know them.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb", "vermin", "filth", "hate you", "shut up", "kill yourself", "go die")
#: Address patterns: who an insult is aimed at.
PATTERNS = ("you are a", "you are an", "you re a", "you re an", "you people", "such a")
_WORD = re.compile(r"[^\W\d_]+")


def normalised(text: bytes) -> str:
    """Lower-case words of letters, single spaces around each."""
    return " " + " ".join(_WORD.findall(text.decode("utf-8", "replace").lower())) + " "


def _features(batches):
    """Per task: how many texts, and toxic texts, each word and stem occurs in."""
    total, toxic = Counter(), Counter()
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        view = memoryview(data)
        for a, b, y in zip(offs[:-1], offs[1:], batch["y"].to_pylist()):
            words = set(normalised(bytes(view[a:b])).split())
            found = {f" {w} " for w in words if len(w) > 1} | {" " + w[:k] for w in words for k in STEMS if len(w) > k}
            total.update(found)
            if y:
                toxic.update(found)
    names = list(total)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())], names=["feature", "docs", "toxic"])


def _automaton(voters):
    words = ahocorasick.Automaton()
    for k, voter in enumerate(voters):
        words.add_word(voter, k)
    if voters:
        words.make_automaton()
    return words


def _votes(batches, voters, columns):
    """Which voters fire on each text."""
    words = _automaton(voters)
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        view = memoryview(data)
        fired = [sorted({k for _, k in words.iter(normalised(bytes(view[a:b])))}) if voters else [] for a, b in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(fired, pa.list_(pa.int32()))], names=[*columns, "fired"])


def mine(sample: DataFrame) -> list[str]:
    """Words and stems that occur in toxic texts far above their share, strongest
    first; sample: (text, y)."""
    counts = sample.mapInArrow(_features, "feature string, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    kept = counts.where((F.col("toxic") >= LEAST_DOCS) & ((F.col("toxic") + 0.1) / (F.col("docs") + 1) >= LEAST_SHARE))
    strength = (F.col("toxic") * 2 - F.col("docs")) * F.pow((F.col("toxic") + 0.1) / (F.col("docs") + 1), 2)
    return [r["feature"] for r in kept.orderBy(strength.desc(), F.length("feature").desc(), "feature").limit(MOST_VOTERS).collect()]


def merged(fires: np.ndarray, alike: float = ALIKE) -> list[int]:
    """Columns to keep: each that fires, unless it fires like one kept before it."""
    together, kept = fires.T @ fires, []
    total = np.diag(together)
    for k in np.flatnonzero(total):
        if not len(kept) or (together[k, kept] < alike * np.sqrt(total[k] * total[kept])).all():
            kept.append(int(k))
    return kept


def label_model(fires: np.ndarray, y: np.ndarray, rounds: int = 25):
    """EM over a latent label.  fires: texts x voters, y: the given label.  Returns
    the posterior, each voter's rates on toxic and on clean texts, and its weight."""
    x = np.hstack((fires, y[:, None])).astype(float)
    post = np.clip(0.9 * y + 0.05, 0, 1).astype(float)
    weight = np.ones(x.shape[1])
    hi = lo = None
    for step in range(rounds):
        share = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        hi = (post @ x + 0.05) / (post.sum() + 1)
        lo = ((1 - post) @ x + 0.02) / ((1 - post).sum() + 1)
        if step % 8 == 0:
            # What is left when the label has explained its part; voters that still
            # move together count together as little more than one.
            rest = (x - (post[:, None] * hi + (1 - post)[:, None] * lo)) / np.sqrt(post[:, None] * hi * (1 - hi) + (1 - post)[:, None] * lo * (1 - lo) + 1e-9)
            corr = rest.T @ rest / len(x)
            corr[:, -1] = corr[-1, :] = 0
            np.fill_diagonal(corr, 1)
            weight = 1 / np.where(corr > 0.2, np.minimum(corr, 1), 0).sum(axis=1).clip(1)
        on, off = weight * np.log(hi / lo), weight * np.log((1 - hi) / (1 - lo))
        odds = np.log(share / (1 - share)) + x @ on + (1 - x) @ off
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, hi[:-1], lo[:-1], weight[:-1]


def linear(fires: np.ndarray, post: np.ndarray, penalty: float = 1e-3, rounds: int = 300):
    """Logistic regression on soft labels, by accelerated gradient steps; weights of
    the voters, of having any voter at all, and the constant."""
    x = np.hstack((fires, (fires.sum(axis=1, keepdims=True) > 0), np.ones((len(fires), 1)))).astype(np.float64)
    w = ahead = np.zeros(x.shape[1])
    step = 4 / max(1.0, np.linalg.norm(x.T @ x / len(x), 2))
    for k in range(rounds):
        grad = x.T @ (1 / (1 + np.exp(-(x @ ahead))) - post) / len(x) + penalty * ahead * np.append(np.ones(x.shape[1] - 1), 0)
        new = ahead - step * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED):
    """(voters, weights), or None where no labelled document is found."""
    ids = labelled(labels, "toxic", FOLDS, HELD_OUT, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # about ``most`` ids
    sample = common.materialize(rows.select("text", "y"), "toxic-sample")
    voters = list(dict.fromkeys([f" {x} " for x in LEXICON] + [f" {x} " for x in PATTERNS] + mine(sample)))
    votes = sample.mapInArrow(lambda it: _votes(it, voters, ["y"]), "y int, fired array<int>").toArrow().combine_chunks()
    if not votes.num_rows:
        return None
    fires = np.zeros((votes.num_rows, len(voters)), dtype=np.float32)
    lists = votes["fired"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    fires[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    kept = merged(fires)
    post, _, _, _ = label_model(fires[:, kept], votes["y"].to_numpy())
    return [voters[k] for k in kept], linear(fires[:, kept], post)


def _scores(batches, model):
    voters, weights = model
    for batch in _votes(batches, voters, ["doc_id"]):
        lists = batch["fired"]
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        hits = lists.flatten().to_numpy()
        odds = np.bincount(owner, weights=weights[hits], minlength=len(lists)) + weights[-1]
        odds += weights[-2] * (np.bincount(owner, minlength=len(lists)) > 0)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], names=["doc_id", "score"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` (doc_id, toxic) teaches by the rows outside the held-out fold; null
    labels and ids teach nothing, of repeated labels the larger counts.  Null and
    empty texts have no votes and get the classifier's constant.  A null doc_id is
    held in or out as the empty id is.  Repeated rows are scored alike.  Other columns
    are not read.  Without any labelled row every score is 0.5.  An empty table gives
    an empty result.
    """
    model = fit(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.select("doc_id", F.lit(0.5).alias("score")) if model is None else rows.mapInArrow(lambda it: _scores(it, model), "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
