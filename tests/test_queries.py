"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from trovex.plans import registry
from trovex.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def plain(df):
    def one(x):
        if x is None or x != x:
            return None
        if isinstance(x, float):
            return round(x, 4) + 0.0
        return x if isinstance(x, (str, bool)) else int(x) if hasattr(x, "__int__") else str(x)

    names = sorted(df.columns)
    return names, sorted(str([one(x) for x in row]) for row in df[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert plain(registry.queries()[name](spark, SF).toPandas()) == plain(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
