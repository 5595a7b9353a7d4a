"""Every registered query against its DuckDB text."""

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.001"


def rows(found):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name in registry.oracle_sql():
        found = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows(got) == rows(tuple(r[i] for i in order) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
