"""Every registered query of the package against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from riskweave.plans import registry, views

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in views.TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.oracle_sql():
        assert found
        return
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert found == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
