"""Operators 11 to 13: shards, vector codes and fill-in-middle."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faremill.llm import fill_in_middle as fim
from faremill.llm import sharding, vector_codes

from .conftest import odd_rows, words


# --- sharding -----------------------------------------------------------------------
def check_shards(rows, got, shards=8):
    """What holds whatever the links: rows, sizes, equal counts, gapless slots, and no
    more parted groups than cuts.  Returns shards by text."""
    data = [(t or "").encode() for _, t in rows]
    assert Counter((r.doc_id, r.size, r.crc) for r in got) == Counter((i, len(b) + 1, zlib.crc32(b)) for (i, _), b in zip(rows, data))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    have = [len(by[s]) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(have) - min(have) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    ids = defaultdict(set)
    for (i, _), b in zip(rows, data):
        ids[i].add(b)
    where = defaultdict(Counter)
    for r in got:
        if len(ids[r.doc_id]) == 1:
            where[next(iter(ids[r.doc_id]))][r.shard] += 1
    least = sum(math.ceil(sum(c.values()) / max(have)) - 1 for c in where.values())
    assert sum(len(c) - 1 for c in where.values()) <= least + shards - 1
    return where


def test_shards_of_odd_rows(spark, odd, none):
    rows = [r[:2] for r in odd_rows()]
    check_shards(rows, sharding.sharded(odd).collect())
    assert sharding.sharded(none).count() == 0
    few = spark.createDataFrame([(1, "a"), (None, None), (1, "")], "doc_id long, text string")
    check_shards([(1, "a"), (None, None), (1, "")], sharding.sharded(few).collect())


def test_shards_keep_links_and_split_hot_groups(spark):
    """A third of all rows of one text fill whole shards; other copies stay together,
    and nearly all near copies do; a rerun over other partitions gives the same."""
    rng = random.Random(5)
    rows, families = [(i, "hot text of many rows") for i in range(1300)] + [(None, "none")] * 90, []
    i = 2000
    for g in range(250):
        sentences = [words(1000 * g + k, 8, 5000) for k in range(12)]
        mine = []
        for _ in range(rng.randrange(2, 7)):
            own = [words(rng.randrange(1 << 30), 8, 5000) if rng.random() < 0.08 else s for s in sentences]
            mine.append(i)
            rows.append((i, ". ".join(own)))
            i += 1
        families.append(mine)
    rows += [(i + k, words(7_000_000 + k, 30, 5000) + ". A line that a great many documents have in common") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(df.repartition(5)).collect()
    where = check_shards(rows, got)
    assert len(where[b"hot text of many rows"]) <= 4
    at = {r.doc_id: r.shard for r in got}
    together = sum(max(Counter(at[i] for i in f).values()) for f in families) / sum(map(len, families))
    assert together > 0.9
    again = sharding.sharded(df.repartition(3)).collect()
    key = lambda rows: sorted((repr(r.doc_id), r.shard, r.slot) for r in rows)
    assert key(got) == key(again)


def test_propagation_moves_units_to_their_neighbours_within_the_room(spark):
    """Random labels end with fewer cut links, and no shard above its room."""
    rng = random.Random(6)
    links = [(u, u // 8, 1) for u in range(1600)] + [(u, 10_000 + rng.randrange(100), 1) for u in range(0, 1600, 4)]
    labels = [(u, 1, rng.randrange(4)) for u in range(1600)]
    room = 450
    # what is above its room at first may only shrink
    first = Counter(x for _, _, x in labels)
    ld = spark.createDataFrame(links, "unit long, hub long, n long")
    out = {r.unit: r.label for r in sharding.propagated(ld, spark.createDataFrame(labels, "unit long, n long, label int"), range(4), room, 6).collect()}
    load = Counter(out.values())
    assert len(out) == 1600 and all(load[s] <= max(room, first[s]) for s in range(4))
    kept = lambda lab: sum(lab[u] == lab[u + 1] for u in range(1600) if u % 8 < 7)
    assert kept(out) > 2 * kept({u: x for u, _, x in labels})


def test_votes_against_a_plain_count(spark):
    rng = random.Random(7)
    links = sorted({(rng.randrange(60), rng.randrange(25)) for _ in range(200)})
    n, label = {u: rng.randrange(1, 5) for u in range(60)}, {u: rng.randrange(3) for u in range(60)}
    got = sharding.votes(spark.createDataFrame([(u, h, n[u]) for u, h in links], "unit long, hub long, n long"), spark.createDataFrame([(u, n[u], label[u]) for u in range(60)], "unit long, n long, label int"), range(3))
    members = defaultdict(list)
    for u, h in links:
        members[h].append(u)
    want = defaultdict(lambda: [0, 0, 0])
    for u, h in links:
        others = [v for v in members[h] if v != u]
        for s in range(3):
            want[u][s] += math.floor(1e6 * sum(n[v] for v in others if label[v] == s) / sum(n[v] for v in others)) if others else 0
    assert {r.unit: [r.v0, r.v1, r.v2] for r in got.collect()} == dict(want)


def test_sharding_runs_no_python(odd):
    plan = sharding.sharded(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- fill-in-middle -----------------------------------------------------------------
def made(doc_id, text):
    """One example by hand: (n, form, prefix_chars, middle_chars, output)."""
    t = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def check_fim(rows, df):
    out = fim.fill_in_middle(df)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, *made(i, t)) for i, t in rows)
    assert all(r.back == r.text for r in got)
    return got


def test_fill_in_middle_of_odd_rows(odd, none):
    check_fim([r[:2] for r in odd_rows()], odd)
    assert fim.fill_in_middle(none).count() == 0


def test_fill_in_middle_of_texts_near_sentinels(spark):
    rng = random.Random(4)
    bits = ["<", ">", "P", "S", "M", "<P", "S>", "<<", "P>", "é", "😀", "\r\n", "\n", " "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))) for i in range(1500)] + [(9, "a<M>b"), (2, "a\u0000b"), (77, "𝔘" * 50)]
    got = check_fim(rows, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_takes_no_shuffle_and_no_python(spark, odd):
    plan = fim.fill_in_middle(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("regexp_extract_all") == 1


# --- vector codes -------------------------------------------------------------------
def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, vector, label) rows, all kept and integer: code, error and books by loops."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    x = [r[1] for r in rows]
    w = len(x[0]) // parts
    cut = lambda v, k: v[k * w : (k + 1) * w]
    books = [[cut(x[i], k) for i in order[:entries]] for k in range(parts)]
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    best = lambda v, k: min((d2(cut(v, k), e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            mine = defaultdict(list)
            for v in x:
                mine[best(v, k)[1]].append(cut(v, k))
            new.append([[sum(c) // len(c) for c in zip(*mine[j])] if j in mine else e for j, e in enumerate(books[k])])
        books = new
    return [(r[0], r[2], bytes(best(v, k)[1] for k in range(parts)), sum(best(v, k)[0] for k in range(parts))) for r, v in zip(rows, x)], books


def check_codes(spark, rows, bad=()):
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label string").withColumns({c: F.lit("x") for c in ("name", "code", "error", "members")}).repartition(3)
    got, books = vector_codes.compressed(df)
    want, expected = brute([(i, [math.floor(256 * np.float32(c).item()) for c in v], y) for i, v, y in rows])
    per = defaultdict(int)
    for _, y, _, e in want:
        per[y] += e
    assert [b.tolist() for b in books] == expected
    assert Counter((r.vec_id, r.label, bytes(r.code), r.error, r.label_error) for r in got.collect()) == Counter((i, y, c, e, per[y]) for i, y, c, e in want)
    return books


def test_vector_codes(spark):
    """Ties, repeated rows and ids, null ids and labels, one label with most rows, and
    vectors that are dropped."""
    rng = random.Random(3)
    # few values: equal distances everywhere
    rows = [(rng.choice([None, *range(300)]), [rng.randrange(-3, 4) / 256 for _ in range(32)], rng.choice(["a", "a", "a", "b", None])) for _ in range(400)]
    rows += rows[:30] + [(1000 + i, [0.0] * 32, "v") for i in range(40)]
    nan, inf = float("nan"), float("inf")
    bad = [(5, None, "a"), (-1, [0.0] * 31 + [None], "a"), (-2, [nan] + [0.0] * 31, None), (-3, [0.0] * 31 + [inf], "b"), (-4, [-inf] * 32, "b"), (-5, [], "a")]
    check_codes(spark, rows, bad)
    books = check_codes(spark, [(i, [rng.gauss(0, 1) for _ in range(16)], "a") for i in range(20)], bad)
    assert len(books[0]) == 20  # fewer vectors than entries


def test_vector_codes_of_nothing(spark):
    got, books = vector_codes.compressed(spark.createDataFrame([(1, None, 0)], "vec_id long, embedding array<double>, label int"))
    assert got.count() == 0 and books == []
    with pytest.raises(Exception, match="different lengths"):
        vector_codes.compressed(spark.createDataFrame([(1, [1.0] * 16, 0), (2, [1.0] * 32, 0)], "vec_id long, embedding array<double>, label int").coalesce(1))


@pytest.mark.parametrize("seed, m, w, spread", [(1, 64, 4, 40), (2, 64, 4, 2), (3, 7, 3, 5), (4, 1, 2, 9), (5, 200, 5, 1 << 24)])
def test_tree_finds_the_nearest_entry_and_the_lowest_of_ties(seed, m, w, spread):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-spread, spread + 1, (m, w)), rng.integers(-spread, spread + 1, (2000, w))
    who, best = vector_codes.Tree(entries).nearest(x)
    d2 = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (who == d2.argmin(1)).all() and (best == d2.min(1)).all()


def test_tree_leaves_entries_out():
    """The search compares fewer entries than there are."""
    rng = np.random.default_rng(6)
    tree, met = vector_codes.Tree(rng.integers(-99, 100, (64, 4))), []
    take = tree._take
    tree._take = lambda square, entry, at, best, who: (met.append(len(at)), take(square, entry, at, best, who))
    tree.nearest(rng.integers(-99, 100, (1000, 4)))
    assert sum(met) < 0.7 * 64 * 1000  # both passes together, on points without clusters


def test_codes_stand_for_their_vectors():
    rng = np.random.default_rng(8)
    v = rng.normal(0, 0.1, (500, 16))
    at, x = vector_codes.integers(pa.array(v.tolist()))
    books = [x[:64, k : k + 1] for k in range(16)]
    codes, squares = vector_codes.assigned(x, vector_codes.trees(books))
    near = vector_codes.decoded(codes, books)
    assert len(at) == 500 and abs(near - v).mean() < 0.02 and (squares >= 0).all()
