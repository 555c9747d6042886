"""Each query with an oracle against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from vellumspark.plans.all import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_oracle(name, spark, db):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    assert got == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() >= 0
