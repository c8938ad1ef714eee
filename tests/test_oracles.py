"""Every core query with an SQL oracle, held against it on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidewright.plans import registry

ORACLES = registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in glob.glob(small + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, small, con):
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = con.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want


def test_flagship(spark, small):
    assert registry.flagship(spark, small).count() > 0
