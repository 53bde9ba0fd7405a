"""The operators' queries against their SQL on the test tables."""

import os

import duckdb
import pytest

from faremill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(x):
    return float(f"{float(x):.9g}") if hasattr(x, "__float__") and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(x) for x in r) for r in duck.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall()), key=repr)
    assert got == want and got


def test_shards_of_the_test_tables(spark):
    """Copies that fit a shard stay together but for one group a cut; near copies, told by
    a shared line, mostly do."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op11_sharding"](spark, SF).collect()
    assert [f.name for f in queries.QUERIES["op11_sharding"](spark, SF).schema.fields][:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    at, texts = {r.doc_id: r.shard for r in got}, defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.text].append(r.doc_id)
    n = Counter(at.values())
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1 and all({r.law, r.grown_shard} == {"rows", None} for r in got)
    assert sum(len({at[i] for i in ids}) > 1 for ids in texts.values()) <= 7
