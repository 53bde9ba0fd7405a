"""The driver contract: queries run, and agree with DuckDB on their oracle SQL."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract
from faremill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without a row on the smallest tables: no gap, no repeated key, no whole month.
EMPTY = ("month_gaps", "key_duplicates", "cpi_timeline")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(f"{float(x):.9g}") if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else str(x)


def test_oracles_bind(duck):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert len(registry.QUERIES) > 50 and set(oracles) <= set(queries)
    for name, sql in registry.ORACLES.items():
        assert duck.execute(f"select * from ({sql}) limit 0").description, name


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(x) for x in r) for r in duck.execute(f'select {", ".join(chr(34) + c + chr(34) for c in cols)} from ({registry.ORACLES[name]})').fetchall()), key=repr)
    assert got == want
    assert got or name in EMPTY


def test_month_gaps_reads_every_row(spark, duck):
    sql = "with m as (select distinct date_trunc('month', l_shipdate)::date as d from lineitem) select strftime(s.d, '%Y-%m') from (select unnest(generate_series((select min(d) from m), (select max(d) from m), interval 1 month))::date as d) s where s.d not in (select d from m)"
    got = sorted(r.month for r in registry.QUERIES["month_gaps"](spark, SF).collect())
    assert got == sorted(m for (m,) in duck.execute(sql).fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
