"""Operators 3, 5, 7 and 8 against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from faremill.llm import common, components, embedding_dedup, exact_dedup, simhash_dedup, substring_dedup

from .conftest import odd_rows, words


def lower(t):
    return (t or "").encode().lower()


# --- exact dedup ---------------------------------------------------------------
def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 10), (5, 5), (1000, 1 << 48), (300, 301)):
        values = np.unique(rng.integers(0, top, n))
        shift, code = exact_dedup.golomb_encode(values, 0)
        assert (exact_dedup.golomb_decode(code, len(values), 0, shift) == values).all()


def test_exact_duplicates(odd):
    got = exact_dedup.exact_duplicates(odd).collect()
    groups = defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[lower(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(text).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_duplicates_of_nothing(none):
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_copies_of_one_text_are_not_sorted_in_one_task(spark):
    """Many rows alike in text, in id, in both: one of each text is kept."""
    rows = [(i, "") for i in range(300)] + [(299, "")] * 1200 + [(None, "n")] * 1500 + [(5, "once")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    have = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect())
    want = Counter({(i, 299, 1500, False): 1 for i in range(299)}) + Counter({(299, 299, 1500, False): 1200, (299, 299, 1500, True): 1, (None, None, 1500, False): 1499, (None, None, 1500, True): 1, (5, 5, 1, True): 1})
    assert have == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


# --- substring dedup --------------------------------------------------------------
def brute_repeats(rows, window=20):
    seen, out = set(), []
    docs = sorted(((-(2**63) if i is None else i), k) for k, (i, *_) in enumerate(rows))
    tokens = {k: lower_none(rows[k][1]) for _, k in docs}
    for _, k in docs:
        w, gone = tokens[k], set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((rows[k][0], len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def lower_none(t):
    return (t or "").encode().split()


def test_repeats_match_brute_force(spark):
    shared = [words(10 + k, 45) for k in range(4)]
    rng = random.Random(5)
    rows = []
    for i in range(60):
        parts = [words(100 + i, rng.randrange(0, 50)), rng.choice(shared), words(200 + i, rng.randrange(0, 30)), rng.choice(shared)[: rng.randrange(50, 200)]]
        rows.append((i * 3 - 40, rng.choice([" ", "\n", " \t "]).join(parts), None, "s", 0))
    rows += [(900, "p q " * 40, None, "s", 0), (901, "p q " * 40, None, "s", 0), (902, words(1, 19), None, "s", 0), (903, words(1, 19), None, "s", 0), (904, words(1, 20), None, "s", 0), (905, words(1, 20), None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = substring_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute_repeats(rows))
    for r in got:
        assert sum(x.end - x.start for x in r.repeats) == r.n_removed


def test_repeats_of_odd_rows(odd, none):
    got = substring_dedup.remove_repeats(odd)
    rows = [r for r in odd_rows() if r[0] != 8]
    have = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got.collect() if r.doc_id != 8 and r.doc_id is not None)
    want = sorted((str(i), a, b) for i, a, b, _ in brute_repeats(odd_rows()) if i != 8 and i is not None)
    assert have == want and got.count() == len(odd_rows()) and len(rows) > 10
    assert substring_dedup.remove_repeats(none).count() == 0


def test_hot_passage_spreads_and_stays_exact(spark, monkeypatch):
    """A passage that every document holds crosses many task edges."""
    monkeypatch.setattr(substring_dedup, "HELD", 40)
    hot = words(77, 40)
    rows = [(i, words(1000 + i, 10) + " " + hot + " " + words(3000 + i, 10), None, "s", 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = substring_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute_repeats(rows))


def stretches(texts, anchor, window=20, cut=16):
    """Sorted stretches of one anchor: (m, key, n, i0, words), up to ``cut`` windows each."""
    rows = []
    for k, t in enumerate(texts):
        w = t.split()
        rows += [(anchor, k, 0, i, " ".join(w[i : i + cut + window - 1]).encode()) for i in range(0, len(w) - window + 1, cut)]
    m, key, n, i0, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(m), pa.array(key), pa.array(n), pa.array(i0, pa.int32()), pa.array(text, pa.binary())], names=["m", "key", "n", "i0", "words"])


def settled_places(batches):
    """Repeated windows (key, place) from what ``_settled`` gives, as the job settles it."""
    out = [r for b in substring_dedup._settled(iter(batches), 20) for r in b.to_pylist()]
    least = {}
    for r in out:
        if r["w"] is not None:
            least[r["w"]] = min(least.get(r["w"], (r["key"], r["i0"])), (r["key"], r["i0"]))
    late = {(r["key"], r["i0"]) for r in out if r["w"] is not None and (r["key"], r["i0"]) != least[r["w"]]}
    return late | {(r["key"], r["i0"] + j) for r in out if r["w"] is None for j in range(16) if r["mask"] >> j & 1}


@pytest.mark.parametrize("bits", [0, 2, 64])
@pytest.mark.parametrize("held", [5, 100_000])
def test_words_decide_where_hashes_of_windows_collide(monkeypatch, bits, held):
    rolling = common.rolling
    monkeypatch.setattr(common, "rolling", lambda h, k: rolling(h, k) & np.uint64((1 << bits) - 1))
    monkeypatch.setattr(substring_dedup, "HELD", held)
    shared = words(3, 70)
    texts = [" ".join((words(50 + k, k % 7), shared, words(90 + k, 5))) for k in range(8)] + [shared.replace("w1", "v1", 1), words(4, 60), words(4, 59) + " w", "a b " * 40]
    seen, want = set(), set()
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                want.add((k, i))
            seen.add(tuple(w[i : i + 20]))
    batch = stretches(texts, 5)
    assert settled_places([batch]) == want
    apart = [stretches(["left " + words(8, 30)] * 2, 1), batch.slice(0, 7), batch.slice(7), stretches([words(9, 30)] * 2, 9)]
    assert {x for x in settled_places(apart) if x[0] > 1} == {x for x in want if x[0] > 1}


def test_texts_are_shuffled_once(spark):
    rows = [(i, words(i % 40, 60), None, "s", 0) for i in range(120)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(brute_repeats(rows))
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    texts = [line for line in final.splitlines() if "hashpartitioning(key" in line and "first" not in line]
    assert final.count("ReusedExchange") >= 2, texts


def signed_hash(t):
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_repeats_of_one_id_gather_nowhere(spark):
    """Many rows of one id: exact, and no list, window or join is by the id alone."""
    shared = [words(20 + k, 30) for k in range(3)]
    texts = [words(5000 + i, 12) + " " + shared[i % 3] + " " + words(7000 + i, 12) for i in range(150)]
    rows = [(i, t, None, "s", 0) for i in (None, 7) for t in texts] + [(i, t, None, "s", 0) for i in (None, 7, -(2**63)) for t in (texts[0], texts[0], "few words", None)]
    rows.sort(key=lambda r: (-(2**63) if r[0] is None else r[0], signed_hash(r[1]), r[0] is not None))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))
    found = got.collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found))) == sorted(map(str, brute_repeats(rows)))
    assert all(sum(x.end - x.start for x in r.repeats) == r.n_removed for r in found)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Aggregate [key" in line or "Join" in line]
    assert len(dealt) >= 3 and all(line.count("n#") for line in dealt) and "Window" not in plan


# --- word hashing ---------------------------------------------------------------------
def test_word_hashes_know_their_words():
    text = "a bb  a\nccccccccccccccc\tbb " + "d" * 40 + " ccccccccccccccc a"
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, first = common.word_spans(data, np.array([0, len(data)]))
    tokens = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
    assert tokens == text.split() and first.tolist() == [0, len(tokens)]
    h = common.hash_words(data, s, e)
    for i, j in combinations(range(len(tokens)), 2):
        assert (h[i] == h[j]) == (tokens[i] == tokens[j])
    x = np.arange(50, dtype=np.uint64)[::-1].copy()
    assert common.sliding_min(x, 13).tolist() == [min(x[i : i + 13]) for i in range(38)]
    assert len(set(common.rolling(np.array([1, 2, 3, 1, 2, 3], np.uint64), 3).tolist())) == 3


# --- simhash -----------------------------------------------------------------------------
def brute_print(t):
    w = lower(t).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_triples_cover_every_four_positions():
    assert len(simhash_dedup.TRIPLES) == 20
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash_dedup.TRIPLES)


def union(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(a) for a in range(n)]


def brute_components(rows):
    prints = [brute_print(t) for _, t, *_ in rows]
    roots = union(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for r, (i, *_) in zip(roots, rows):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return Counter((i, format(p, "016x"), least[r]) for (i, *_), p, r in zip(rows, prints, roots))


def test_near_duplicates_of_odd_rows(odd, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(odd).collect())
    assert got == brute_components(odd_rows())
    assert simhash_dedup.near_duplicates(none).count() == 0


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    """Chains and a large cluster of fingerprints, with lists longer than a block."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 20)
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))) for _ in range(150)}
    x = rng.getrandbits(64)
    for _ in range(30):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = components.connected_components(simhash_dedup.links(df)).collect()
    name = {r.node % (1 << 64): r.component % (1 << 64) for r in found}
    roots = union(len(prints), [(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    ours = [name.get(p, p) for p in prints]
    assert len(set(zip(roots, ours))) == len(set(roots)) == len(set(ours))


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (300, 200), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}


# --- embeddings ---------------------------------------------------------------------------
def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    near = base[:200] + rng.normal(size=(200, 64)) * rng.uniform(0.02, 0.48, size=(200, 1))
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(np.vstack((base, near, base[:20])))]
    rows += [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] + [1.0] * 63), (9003, [None] + [1.0] * 63), (9004, []), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (None, rows[0][1]), (None, None)]
    schema = "vec_id long, embedding array<double>, label int, node string, unit string, times string"
    df = spark.createDataFrame([(*r, None, "x", "x", "x") for r in rows], schema).repartition(3)
    got = embedding_dedup.near_vectors(df).collect()
    good = [(k, np.array(v, dtype=float)) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(a, b) for (a, x), (b, y) in combinations(good, 2) if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9]
    links = Counter(k for p in pairs for k in p)
    have = sum(r.n_links for r in got)
    assert have >= 0.99 * sum(links.values()) and have <= sum(links.values())
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None and r.vec_id >= 9000:
            assert r.n_links == (1 if r.vec_id in (9005, 9006) else 0)
    by = {r.vec_id: r for r in got}
    assert by[9006].component_id == 9005 and not by[9006].kept and by[9005].kept and by[9000].component_id == 9000
    assert all(by[600 + k].component_id == by[k].component_id for k in range(20))
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_collision_count_and_tables_reach_their_recall():
    """Pairs at the threshold: enough windows collide, and a table brings them together."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + math.sqrt(1 - 0.81) * z
    a, b = (v @ embedding_dedup._directions(64) for v in (x, y))
    p = embedding_dedup.PROJECTIONS
    near = np.abs(np.floor(a[:, :p] * 16) - np.floor(b[:, :p] * 16)) <= embedding_dedup.WINDOW
    counted = near.sum(axis=1) >= embedding_dedup.least_count()
    same = (a[:, p:] > 0) == (b[:, p:] > 0)
    for k in (0, 3, 6):
        sides = embedding_dedup.tables(k)
        met = np.any([same[:, row].all(axis=1) & near[:, t % p] for t, row in enumerate(sides)], axis=0)
        assert (counted & met).mean() > 0.98


def test_near_vectors_in_many_tables(spark, monkeypatch):
    """Small buckets, many tables, blocks: links and counts as by brute force, and far
    fewer pairs compared than there are."""
    monkeypatch.setattr(embedding_dedup, "PARTNERS", 32)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 64))
    crowd = base[:1] + rng.normal(size=(250, 64)) * 0.1
    rows = np.vstack((base, base[:300] + rng.normal(size=(300, 64)) * 0.3, crowd)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3)
    x = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    want = close.sum(axis=1)
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.995 * want.sum()

    n, sides = len(rows), embedding_dedup.tables(6)
    signs = (x @ embedding_dedup._directions(64))[:, embedding_dedup.PROJECTIONS :] > 0
    pairs = sum(m * (m - 1) // 2 for row in sides for m in np.unique(signs[: 1500][:, row], axis=0, return_counts=True)[1])
    assert len(sides) < 40 and pairs < 0.4 * 1500 * 1499 / 2
