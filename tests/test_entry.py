"""The registered queries against their oracles, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_core_query_but_a_few_has_an_oracle():
    assert set(CORE) - set(entry.oracle_sql()) == {"bridges_cyclic", "physical_connections", "topology_issues", "raster_conductors"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in entry.oracle_sql():
        want = oracle.sql(entry.oracle_sql()[name])
        order = sorted(range(len(want.columns)), key=lambda k: want.columns[k])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == sorted(repr([plain(r[k]) for k in order]) for r in want.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 150
