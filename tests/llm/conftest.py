import random

import pytest

#: Names that the operators use inside; documents may have columns of the same names.
CLASHING = "key string, n string, size string, row string, score string, keep_id string, bin_id string, fp string, target string, sha string, unit string, y string, epoch string, cut string"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    passage = words(1, 60)
    long = words(2, 60_000, 5_000)
    texts = [
        (1, "a " + passage + " b", "s1"),
        (2, passage.upper() + "\n\t " + words(3, 30), "s1"),
        (3, None, "s2"),
        (4, "", "s2"),
        (5, "   \n ", None),
        (6, long, "s1"),
        (7, long[:200_000] + " tail", "s1"),
        (None, passage + " " + words(4, 25), "s3"),
        (None, None, None),
        (8, passage, "s1"),
        (8, passage, "s1"),
        (8, words(5, 40), "s2"),
        (9, "Same Text", "s1"),
        (10, "same text", "s1"),
        (11, "SAME TEXT", "s9"),
        (12, "x y x y " * 30, "é"),
        (13, "one", "s1"),
        (-5, "Ünïcödé İ ſ K wörter " + passage, "s1"),
    ]
    return [(i, t, None if k % 3 == 0 else "en", s, None if t is None else len(t)) for k, (i, t, s) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity, and columns that clash with the operators' own."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [(*r, *["x"] * len(names)) for r in odd_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
