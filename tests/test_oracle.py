"""Every registered core query with SQL, held against DuckDB on the smallest tables."""

import datetime
import os
from collections import Counter

import duckdb
import pytest

from lorekiln.plans import registry

DATA = os.environ.get("LOREKILN_TEST_DATA", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        p = os.path.join(DATA, f)
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(norm(row[i]) for i in at) for row in r.fetchall())
