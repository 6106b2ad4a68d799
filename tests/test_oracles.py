"""Every core query against its SQL on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from sparkivist.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(canonical, v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(canonical(r[c]) for c in cols)) for r in df.collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    theirs = sorted(repr(tuple(canonical(dict(zip(rel.columns, r))[c]) for c in cols)) for r in rel.fetchall())
    assert ours == theirs
