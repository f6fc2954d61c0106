"""Every registered query of the engine itself against its DuckDB twin, on the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v != v else 0.0 if v == 0 and isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*names).collect())
    cur = con.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted(repr(tuple(plain(r[cols.index(c)]) for c in names)) for r in cur.fetchall())
    assert got == want
