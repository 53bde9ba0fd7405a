"""Substring deduplication: seed and extend on winnowed anchors.

A window is ``WINDOW`` consecutive words of one document.  Its anchor is the least
hash among its ``SEED``-word grams, so two equal windows always meet at the same
anchor (winnowing).  The steps:

1. seed: every document yields the runs of consecutive windows that share an
   anchor; runs are range-sorted by anchor, and an anchor seen once is done with;
2. extend: around each place of a repeated anchor, a stretch of words reaches from it
   both ways as far as windows contain it, up to CUT windows at a time.  The stretches
   of an anchor meet in (document, start) order.  Hashes of windows propose the earliest
   place of each; neighbouring windows with neighbouring proposals are one match, which
   is compared word by word, and where hashes collide the words decide: every window
   but the earliest of its words is a repeat;
3. repeats that overlap or touch merge to maximal repeats of at least ``WINDOW``
   words, and their words go.

Nothing is paired: a frequent passage costs rows in proportion to its copies.  Stretches
are dealt by range over (anchor, document, start), so one hot anchor spreads over
tasks; of a group that touches a task's edge (or outgrows its buffer), each task adds
the windows that are earliest there, and a minimum per window settles these.  Windows of
different tasks are told apart by 128-bit BLAKE2 digests of their words.

Texts are shuffled once: all three steps that read them have the same grouping below
them, whose exchange Spark reuses.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SEED, CUT, HELD, COPIES = 20, 8, 16, 100_000, 10_000
NULL_ID = -(2**63)


def _distinct(docs: DataFrame) -> DataFrame:
    """One row for rows alike in doc_id and text.  key: doc_id, null as the least; n:
    a hash of the text, tells apart the texts of one doc_id; copies: how many rows, of
    which known have a doc_id.  Map tasks merge what is alike before it is dealt out."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("key", F.xxhash64("text").alias("n")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.count("doc_id").alias("known"))


def _within(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of every window that lies within a row."""
    n = max(0, int(first[-1]) - window + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) <= first[1:][row] - window)
    return row[at], at


def _windows(data: np.ndarray, offs: np.ndarray, window: int, seed: int):
    """Of rows in one buffer: anchor, row and first word of each window, first word of
    each row, where a run of one anchor begins, the grams, and the spans of the words.
    Only windows within a row."""
    starts, ends, first = common.word_spans(data, offs)
    h = common.hash_words(data, starts, ends)
    row, at = _within(first, window)
    grams = common.rolling(h, seed)
    anchors = common.sliding_min(grams, window - seed + 1)[at] >> np.uint64(16)
    begin = np.ones(len(at), dtype=bool)
    begin[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(begin)
    inside = np.arange(len(at)) - np.repeat(lead, np.diff(np.append(lead, len(at))))
    return anchors.astype(np.int64), row, at, first, inside % CUT == 0, grams, starts, ends


def _recurs(grams: np.ndarray, reach: int) -> np.ndarray:
    """Whether a gram equals one of the ``reach`` grams before it."""
    close = np.zeros(len(grams), dtype=bool)
    for d in range(1, min(reach + 1, len(grams))):
        close[d:] |= grams[d:] == grams[:-d]
    return close


def _runs(batches, window, seed):
    """(anchor, key, n, start of the run) for each run of windows with one anchor.
    A run whose grams recur within it (periodic text) is its own repeat: it comes
    twice, so that its anchor counts as seen again."""
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        key, n = batch["key"].to_numpy(), batch["n"].to_numpy()
        for a, b in common.row_chunks(offs):
            lo = offs[a]
            anchors, row, at, first, begin, grams, _, _ = _windows(data[lo : offs[b]], offs[a : b + 1] - lo, window, seed)
            lead = np.flatnonzero(begin)
            close = np.concatenate(([0], np.cumsum(_recurs(grams, CUT + window - seed))))
            until = at[np.append(lead[1:], len(at))[: len(lead)] - 1] + window - seed + 1
            lead = np.repeat(lead, 1 + (close[until] > close[at[lead]]))
            r = row[lead]
            yield pa.RecordBatch.from_arrays([pa.array(anchors[lead]), pa.array(key[a + r]), pa.array(n[a + r]), pa.array((at[lead] - first[r]).astype(np.int32))], names=["m", "key", "n", "i0"])


def _repeated(batches):
    """Rows whose anchor a neighbour in the sort order shares.  The first and the
    last row of a task are passed on unseen; a false seed only costs a comparison."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        m = batch["m"].to_numpy()
        same = m[1:] == m[:-1]
        keep = np.zeros(len(m), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held is None:
            keep[0] = True
        else:
            keep[0] |= held_on
        held, held_on = batch.slice(len(m) - 1), bool(keep[-1])
        yield batch.slice(0, len(m) - 1).filter(pa.array(keep[:-1])).select(["key", "n", "i0"])
    if held is not None:
        yield held.select(["key", "n", "i0"])


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins there."""
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + inside] = data[np.repeat(starts, size) + inside]
    return out, at


def _extended(batches, window, seed):
    """The stretch of words of each run that was found to be repeated: all words of its
    windows, with one space between them."""
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        key, n = batch["key"].to_numpy(), batch["n"].to_numpy()
        seeds = batch["seeds"]
        s_off, s_at = seeds.offsets.to_numpy(), seeds.values.to_numpy()
        for a, b in common.row_chunks(offs):
            lo = offs[a]
            anchors, row, at, first, begin, _, starts, ends = _windows(data[lo : offs[b]], offs[a : b + 1] - lo, window, seed)
            marked = np.zeros(first[-1] + 1, dtype=bool)
            owner = np.repeat(np.arange(b - a), np.diff(s_off[a : b + 1]))
            marked[first[owner] + s_at[s_off[a] : s_off[b]]] = True
            lead = np.flatnonzero(begin)
            last = np.append(lead[1:], len(at))[: len(lead)] - 1
            on = marked[at[lead]]
            lead, last = lead[on], last[on]
            text, place = _joined(data[lo : offs[b]], starts, ends)
            tail = at[last] + window - 1
            begins, size = place[at[lead]], place[tail] + ends[tail] - starts[tail] - place[at[lead]]
            for c, d in common.row_chunks(np.concatenate(([0], np.cumsum(size)))):
                r, bounds = row[lead[c:d]], np.zeros(d - c + 1, dtype=np.int32)
                np.cumsum(size[c:d], out=bounds[1:])
                words = text[np.arange(bounds[-1]) + np.repeat(begins[c:d] - bounds[:-1], size[c:d])]
                words = pa.Array.from_buffers(pa.binary(), d - c, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(words.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchors[lead[c:d]]), pa.array(key[a + r]), pa.array(n[a + r]), pa.array((at[lead[c:d]] - first[r]).astype(np.int32)), words], names=["m", "key", "n", "i0", "words"])


def _hashed(data: np.ndarray, offs: np.ndarray, window: int):
    """Row, hash and span of bytes of every window of some stretches."""
    found = []
    for a, b in common.row_chunks(offs):
        lo = offs[a]
        part = data[lo : offs[b]]
        starts, ends, first = common.word_spans(part, offs[a : b + 1] - lo)
        row, at = _within(first, window)
        found.append((a + row, common.rolling(common.hash_words(part, starts, ends), window)[at], lo + starts[at], lo + ends[at + window - 1]))
    return [np.concatenate(x) for x in zip(*found)]


def _differ(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes at ``one`` and at ``two`` differ within ``size``, eight a step."""
    lanes = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    other, rows = np.zeros(len(one), dtype=bool), np.arange(len(one))
    for step in range(0, int(size.max(initial=0)), 8):
        rows = rows[(size[rows] > step) & ~other[rows]]
        bits = np.uint64(8) * np.maximum(0, step + 8 - size[rows]).astype(np.uint64)
        other[rows] = (lanes[one[rows] + step] ^ lanes[two[rows] + step]) << bits != 0
    return other


def _earliest(data, row, hashes, starts, ends) -> np.ndarray:
    """For each window, the earliest one with the same words.  Hashes propose it; matches
    of neighbouring windows are compared as one stretch, and words decide where it fails."""
    _, lead, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    lead = lead[inverse]
    late = np.flatnonzero(lead != np.arange(len(lead)))
    if not len(late):
        return lead
    from_, new = lead[late], np.ones(len(late), dtype=bool)
    new[1:] = (np.diff(late) != 1) | (np.diff(from_) != 1) | (np.diff(row[late]) != 0) | (np.diff(row[from_]) != 0)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(late)) - 1
    size, there = (ends[x[tail]] - starts[x[head]] for x in (late, from_))
    other = size != there
    other[~other] = _differ(data, starts[late[head]][~other], starts[from_[head]][~other], size[~other])
    if other.any():
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(hashes, hashes[late[np.repeat(other, tail - head + 1)]])):
            lead[i] = seen.setdefault(data[starts[i] : ends[i]].tobytes(), i)
    return lead


def _later(batch: pa.RecordBatch, whole: bool, window: int):
    """Of a sorted batch of stretches: rows with a mask, whose bit j says that the
    stretch's window j occurs earlier in the batch.  Unless the batch holds ``whole``
    groups, the earliest occurrence of each window, too, with a digest of its words."""
    key, n, i0 = (batch[c].to_numpy() for c in ("key", "n", "i0"))
    data, offs = common.text_buffer(batch["words"])
    owner, hashes, starts, ends = _hashed(data, offs, window)
    sizes = np.bincount(owner, minlength=len(key))
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lead = _earliest(data, owner, hashes, starts, ends)
    dup = lead != np.arange(len(lead))
    mask = np.bincount(owner[dup], weights=(1 << inside[dup]).astype(float), minlength=len(sizes)).astype(np.int32)
    at = np.flatnonzero(mask)
    yield _row(key[at], n[at], i0[at], mask[at], pa.nulls(len(at), pa.binary()))
    if not whole:
        lead = np.flatnonzero(~dup)
        w = pa.array([hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(starts[lead], ends[lead])], pa.binary())
        at = owner[lead]
        yield _row(key[at], n[at], (i0[at] + inside[lead]).astype(np.int32), np.zeros(len(at), np.int32), w)


def _row(key, n, i0, mask, w) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(i0, pa.int32()), pa.array(mask, pa.int32()), w], names=["key", "n", "i0", "mask", "w"])


def _settled(batches, window):
    """Settle each anchor whose runs all lie within this task.  Of the task's first
    and last anchor, and of one too frequent to hold, other tasks may know earlier
    windows: what is earliest here goes on, one row a window."""
    edge, held, over = None, None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = None
        m = batch["m"].to_numpy()
        edge = m[0] if edge is None else edge
        cut = int(np.searchsorted(m, m[-1]))
        head, tail = batch.slice(0, cut), batch.slice(cut)
        if cut:
            loose = (m[:cut] == edge) | (m[:cut] == (edge if over is None else over))
            if loose.any():
                yield from _later(head.filter(pa.array(loose)), False, window)
            if not loose.all():
                yield from _later(head.filter(pa.array(~loose)), True, window)
        if tail.num_rows > HELD:
            over = m[-1]
            yield from _later(tail, False, window)
        else:
            held = tail
    if held is not None:
        yield from _later(held, False, window)


def _kept(batches, window):
    for batch in batches:
        data, offs = common.text_buffer(batch["text"])
        sizes, gone, digests, spans = [], [], [], []
        hits = batch["hits"].to_pylist()
        for i in range(batch.num_rows):
            words = data[offs[i] : offs[i + 1]].tobytes().split()
            lost = 0
            found = []
            if hits[i]:
                diff = np.zeros(len(words) + 1, dtype=np.int64)
                for hit in hits[i]:
                    for j in range(CUT):
                        if hit["mask"] >> j & 1:
                            diff[hit["i0"] + j] += 1
                            diff[hit["i0"] + j + window] -= 1
                stay = np.cumsum(diff[:-1]) == 0
                lost = int(len(words) - stay.sum())
                if lost:
                    edges = np.flatnonzero(np.diff(np.concatenate(([1], stay.astype(np.int8), [1]))))
                    found = [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])]
                    sizes.append(len(words))
                    words = list(compress(words, stay))
                else:
                    sizes.append(len(words))
            else:
                sizes.append(len(words))
            gone.append(lost)
            spans.append(found)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        key, copies, known = (batch[c].to_numpy() for c in ("key", "copies", "known"))
        yield _result([int(k) if c == w else None for k, c, w in zip(key, copies, known)], sizes, gone, digests, spans)
        for i in np.flatnonzero(copies > 1):
            yield from _copies(int(key[i]), int(copies[i]), int(known[i]), sizes[i], gone[i], digests[i], spans[i], window)


def _copies(key, copies, known, size, lost, digest, span, window):
    """The rows after the first of those alike in doc_id and text: every window of
    theirs is a repeat.  Null ids rank first."""
    if size >= window:
        lost, digest, span = size, hashlib.sha256(b"").hexdigest(), [{"start": 0, "end": size}]
    for doc_id, times in ((None, max(0, copies - known - 1)), (key, known - (copies == known))):
        for at in range(0, times, COPIES):
            k = min(COPIES, times - at)
            yield _result([doc_id] * k, [size] * k, [lost] * k, [digest] * k, [span] * k)


def _result(ids, sizes, gone, digests, spans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256 and
    repeats, the maximal repeated word ranges [start, end) that were removed.

    Null text has no words; texts shorter than a window lose nothing.  A null doc_id
    counts as the least.  Rows that repeat a doc_id count as documents one after
    another, by a hash of their texts, so a repeated row loses its windows.  Nothing is
    grouped by doc_id alone, so one id may have any number of rows.  Other columns of
    ``docs`` are not read.  An empty table gives an empty result.
    """
    parts = 2 * common.shuffle_partitions(docs.sparkSession)
    rows, place = _distinct(docs), ["m", "key", "n", "i0"]
    # Every reader of ``rows`` takes all its columns, so that one exchange serves them all.
    runs = rows.mapInArrow(lambda it: _runs(it, window, seed), "m long, key long, n long, i0 int")
    seeds = runs.repartitionByRange(parts, *place).sortWithinPartitions(*place).mapInArrow(_repeated, "key long, n long, i0 int")
    seeds = seeds.groupBy("key", "n").agg(F.collect_list("i0").alias("seeds"))
    extended = rows.join(seeds.hint("merge"), ["key", "n"]).mapInArrow(lambda it: _extended(it, window, seed), "m long, key long, n long, i0 int, words binary")
    settled = extended.repartitionByRange(parts, *place).sortWithinPartitions(*place).mapInArrow(lambda it: _settled(it, window), "key long, n long, i0 int, mask int, w binary")
    # Windows of different tasks: the least place of each stays.  A window has a place a
    # task and one for HELD stretches of its anchor; rows without w need no company.
    loose, at = F.col("w").isNotNull(), F.struct("key", "n", "i0", "mask")
    same = settled.groupBy("w", F.when(~loose, F.xxhash64("key", "n", "i0")).alias("alone")).agg(F.collect_list(at).alias("places"))
    late = same.select("w", F.array_min("places").alias("least"), F.inline("places")).where(~loose | (at != F.col("least")))
    hits = late.select("key", "n", "i0", F.when(loose, 1).otherwise(F.col("mask")).alias("mask"))
    hits = hits.groupBy("key", "n").agg(F.collect_list(F.struct("i0", "mask")).alias("hits"))
    final = rows.join(hits.hint("merge"), ["key", "n"], "left")
    return final.mapInArrow(lambda it: _kept(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,end:int>>")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir)).drop("repeats")


#: Every 20-word window of every document, compared by its words.
OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, s, sha256(array_to_string(list_slice(w, s, s + 19), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs)
), late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late
), lost AS (
  SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id
), words AS (
  SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs)
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM docs LEFT JOIN lost ON docs.doc_id = lost.doc_id LEFT JOIN kept ON docs.doc_id = kept.doc_id
"""
