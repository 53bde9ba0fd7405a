"""Operators 2, 6, 9 and 10, and the pipeline."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from faremill.llm import mixing, packing, quality, queries, toxicity

from .conftest import odd_rows, words

FAIR = "river stone garden evening window quiet letter morning bread table candle harbor meadow silver".split()


def corpus(n):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.8, rng.random() < 0.25
        w = [rng.choice(FAIR) + rng.choice(["", "s", "ly", "er"]) for _ in range(rng.randrange(12, 120))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grulk" + rng.choice(["a", "en", "ist"]), "scum"]))
        t = " ".join(w)
        docs.append((i, t if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus(900)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("score, column, folds, held", [(quality.quality_scores, 1, 5, 0), (toxicity.toxicity_scores, 2, 4, 2)])
def test_held_out_accuracy(learned, score, column, folds, held):
    docs, labels, truth = learned
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == len(truth)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [t for t in truth if got[t[0]].held_out]
    assert len(out) > 100 and np.mean([got[t[0]].predicted == t[column] for t in out]) > 0.95


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_toxic_documents_that_were_not_taught_are_caught(spark, monkeypatch):
    """The label model does not fall below the given labels, and both catch nine in ten."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}

    def caught():
        rows = [r for r in toxicity.toxicity_scores(docs, labels).where("held_out").collect() if truth.get(r.doc_id) is not None]
        hit, said, there = (sum(x) for x in zip(*[(r.predicted * truth[r.doc_id], r.predicted, truth[r.doc_id]) for r in rows]))
        assert len(rows) > 900 and there > 100
        return hit / there, hit / said

    recall, precision = caught()
    monkeypatch.setattr(toxicity, "label_model", lambda fires, y: (y.astype(float), None, None, None))
    plain = caught()
    assert recall >= 0.9 and precision >= 0.9 and recall >= plain[0] - 0.01


def test_voters_that_fire_alike_are_merged():
    x = np.array([[1, 1, 0, 0, 1], [1, 1, 1, 0, 0], [1, 1, 0, 0, 0], [0, 0, 1, 0, 1]], dtype=np.float32)
    assert toxicity.merged(x) == [0, 2, 4]


def test_held_out_labels_teach_nothing(learned, spark):
    """Scores stay as they are when the held-out labels turn around."""
    docs, labels, _ = learned
    for score, c, folds, held in ((quality.quality_scores, "quality", 5, 0), (toxicity.toxicity_scores, "toxic", 4, 2)):
        turned = labels.selectExpr("doc_id", f"case when crc32(cast(doc_id as string)) % {folds} = {held} then 1 - {c} else {c} end as {c}")
        a = {r.doc_id: round(r.score, 9) for r in score(docs, labels).collect()}
        assert a == {r.doc_id: round(r.score, 9) for r in score(docs, turned).collect()}


def test_scores_of_odd_rows(spark, odd, none, learned):
    labels = learned[1].unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int"))
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        got = score(odd, labels).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert score(none, labels).count() == 0
        assert {r.score for r in score(odd, labels.where("false")).collect()} == {0.5}


def test_isotonic_is_monotone_and_pools():
    x, v = quality.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(v) >= 0).all() and abs(np.interp(3, x, v) - 1 / 3) < 0.01


def test_label_model_discounts_voters_that_move_together():
    rng = np.random.default_rng(2)
    y = (rng.random(2000) < 0.3).astype(int)
    fire = lambda p, q: (rng.random(2000) < np.where(y == 1, p, q)).astype(float)
    a, b, c = fire(0.6, 0.02), fire(0.6, 0.02), fire(0.3, 0.25)
    noisy = np.where(rng.random(2000) < 0.1, 1 - y, y)
    post, hi, lo, weight = toxicity.label_model(np.stack((a, b, c, c, c), axis=1), noisy)
    assert weight[0] > 0.9 and weight[2] < 0.5
    assert ((post > 0.5) == y).mean() > 0.9 and hi[0] > lo[0]


# --- mixing ----------------------------------------------------------------------
def level(sizes):
    """Water filling by rounds: full sources stop, what is left is shared again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    rest, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not full:
            out.update({s: share * weight[s] for s in open_})
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        open_ -= full
    return out


def check_mix(rows, got):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").encode().split())
    want = level(size)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert taken[s] == int(want[s] + 1e-6) or abs(taken[s] - want[s]) <= 1
    assert len(got) == len(rows)


def test_mix_reaches_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, words(i, rng.randrange(0, 60)), rng.choice(["hot"] * 10 + ["a", "b", "c", "é", None, "tiny"])) for i in range(700)] + [(900, "one two", "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixed(df).collect()
    check_mix(rows, got)
    again = mixing.mixed(df.repartition(2)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_mix_of_odd_rows(odd, none):
    got = mixing.mixed(odd).collect()
    check_mix([(i, t, s) for i, t, _, s, _ in odd_rows()], got)
    assert mixing.mixed(none).count() == 0
    assert mixing.mixed(odd.where("text is null")).agg({"taken": "sum"}).first()[0] == 0


# --- packing ------------------------------------------------------------------------
def test_mix_of_one_id_is_not_summed_in_one_window(spark):
    """Rows of no id or of one id: exact, and counted by size before the window."""
    rows = [(i, "w " * (k % 4), s) for k in range(1200) for i, s in ((None, "a"), (7, "b"))] + [(k, "w w", "c") for k in range(40)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    check_mix(rows, got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "Window" in line and "bucket" in line and "doc_id" in line)
    assert any("Aggregate [source" in line and "doc_id" in line for line in plan[at + 1 : at + 4])


def naive_best_fit(pieces, capacity, slots):
    bins = []
    out = []
    for size, source, cluster in pieces:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and b["left"] > 0 and cluster not in b["clusters"] and b["sources"][source] < slots]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append({"left": capacity, "clusters": set(), "sources": Counter()})
        bins[k]["left"] -= size
        bins[k]["clusters"].add(cluster)
        bins[k]["sources"][source] += 1
        out.append(k)
    return out


def test_best_fit_equals_a_plain_search():
    rng = random.Random(4)
    for slots in (1, 2, 8):
        pieces = [(rng.randrange(1, 100), rng.choice([0] * 6 + [1, 2, 3]), rng.choice([*range(8), *range(100, 400)])) for _ in range(400)]
        got = packing.best_fit([p[0] for p in pieces], [1 << p[1] for p in pieces], [1 << p[2] for p in pieces], 128, slots)
        assert got == naive_best_fit(pieces, 128, slots)


def check_packing(rows, got, capacity, slots):
    pieces, bins = defaultdict(list), defaultdict(list)
    cluster = defaultdict(set)
    for i, t, s in rows:
        cluster[i].add(((t or "").encode().lower(), s))
    for r in got:
        pieces[r.doc_id].append((r.start_word, r.n_words))
        if r.bin_id is None:
            assert r.n_words == 0
        else:
            bins[r.bin_id].append(r)
    want = defaultdict(Counter)
    for i, t, _ in rows:
        n = len((t or "").encode().split())
        for a in range(0, max(1, n), capacity):
            want[i][a, min(capacity, n - a)] += 1
    assert {i: Counter(p) for i, p in pieces.items()} == dict(want)
    for members in bins.values():
        assert sum(r.n_words for r in members) == members[0].bin_words <= capacity
        texts = [next(iter(cluster[r.doc_id])) for r in members if len(cluster[r.doc_id]) == 1]
        assert max(Counter(t for t, _ in texts).values(), default=1) == 1
        assert max(Counter(s for _, s in texts).values(), default=0) <= slots
    return bins


def test_packing_keeps_every_word_and_no_conflict(spark):
    rng = random.Random(2)
    texts = [words(k, rng.randrange(1, 90)) for k in range(250)]
    rows = [(i, rng.choice(texts).upper() if rng.random() < 0.2 else rng.choice(texts), rng.choice(["hot"] * 4 + ["a", "b"])) for i in range(600)] + [(1000, words(5, 700), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bins = check_packing(rows, packing.packed(df, 256, 4).collect(), 256, 4)
    assert sum(b[0].bin_words for b in bins.values()) / (256 * len(bins)) > 0.8


def test_packing_of_odd_rows(odd, none):
    rows = [(i, t, s) for i, t, _, s, _ in odd_rows()]
    check_packing(rows, packing.packed(odd, 1000, 2).collect(), 1000, 2)
    assert packing.packed(none).count() == 0


# --- pipeline ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    docs, labels = corpus(300)
    folder = str(tmp_path_factory.mktemp("tables"))
    extra = [(2000 + i, d[1]) for i, d in enumerate(docs[:40])] + [(3000, docs[0][1] + " end")]
    d = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in docs + extra], "doc_id long, text string, lang string, source string, n_chars long")
    odd.unionByName(d, allowMissingColumns=True).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    return folder


def test_stages_decide_and_keep_their_columns(spark, tables):
    docs = spark.read.parquet(tables + "/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.common.materialize(stage(spark, docs, tables), name)
        assert docs.columns == columns and dict(docs.dtypes) == dict(before.dtypes)
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    norm = lambda rows: [(t or "").encode().lower() for _, t in rows]
    assert not any("!!" in (t or "") for _, t in seen["quality"]) and len(seen["quality"]) > 150
    assert Counter(norm(seen["exact_dedup"])) == Counter(set(norm(seen["quality"])))
    assert set(seen["simhash_dedup"]) <= set(seen["exact_dedup"])
    sizes = lambda rows: sum(len((t or "").encode().split()) for _, t in rows)
    assert abs(sizes(seen["source_mix"]) - sizes(seen["simhash_dedup"])) <= 20
    last = corpus_pipeline.packing(spark, docs, tables)
    assert last.agg({"n_words": "sum"}).first()[0] == sizes(seen["source_mix"])


def test_rows_are_told_apart_alike_in_every_run(spark, odd):
    """Null and repeated ids get ids in the order of (doc_id, row), whatever the partitions."""
    docs = odd.unionByName(odd.where("doc_id is null or doc_id = 8"))
    runs = [sorted((r.doc_id, repr(r.row)) for r in corpus_pipeline._keyed(docs.repartition(n)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and [i for i, _ in runs[0]] == list(range(docs.count()))
    by_id = [r.row.doc_id for r in sorted(corpus_pipeline._keyed(docs).collect(), key=lambda r: r.doc_id)]
    assert by_id == sorted(by_id, key=lambda i: (i is not None, i or 0))


def test_stages_of_nothing(spark, tables, none):
    empty = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    found = {q.split("_")[0] for q in queries.QUERIES}
    assert found == {f"op{n}" for n in range(1, 14)} and set(queries.ORACLES) <= set(queries.QUERIES)
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash_dedup", "source_mix", "packing"]


def test_packing_reruns_agree(spark, odd):
    runs = [sorted(map(repr, packing.packed(odd.repartition(n), 100, 2).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_quality_of_documents_that_were_not_taught(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.quality_scores(docs, labels).where("held_out").collect() if truth.get(r.doc_id) is not None]
    right = sum(r.predicted == truth[r.doc_id] for r in rows)
    good, bad = ([r.score for r in rows if truth[r.doc_id] == y] for y in (1, 0))
    assert len(rows) > 700 and right / len(rows) > 0.95 and min(len(good), len(bad)) > 50
    above = sum(sum(g > b for b in bad) + 0.5 * sum(g == b for b in bad) for g in good)
    assert above / (len(good) * len(bad)) > 0.98
