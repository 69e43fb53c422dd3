"""Every registered query against its SQL, on the smallest tables, where they are present."""

import math
import os

import pytest

ROOT = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return str(v) if isinstance(v, (list, tuple, dict)) else v


def names():
    from lectern.plans import ORACLES

    return sorted(ORACLES)


@pytest.fixture(scope="module")
def sql():
    import duckdb

    found = duckdb.connect()
    for f in os.listdir(ROOT):
        found.sql(f"create view {f.removesuffix('.parquet')} as select * from '{ROOT}/{f}'")
    return found


@pytest.mark.parametrize("name", names())
def test_query_matches_its_sql(spark, sql, name):
    from lectern.plans import ORACLES, QUERIES

    df = QUERIES[name](spark, ROOT)
    want = sql.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    assert got == sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=repr)
