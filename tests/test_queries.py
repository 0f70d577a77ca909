"""The registered queries of the engine against their SQL, on the smallest tables: a fourth of them, all with GROVE_ALL=1."""

import os

import duckdb
import pytest

from sparkgrove.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE)[:: 1 if os.environ.get("GROVE_ALL") else 4])
def test_query_equals_sql(spark, database, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = database.execute(registry.ORACLE[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == names
    rows = sorted(tuple(plain(r[at.index(c)]) for c in names) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == rows
