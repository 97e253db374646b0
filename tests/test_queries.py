"""Every query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from tests.conftest import SF
from trackweave import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v if v is None else str(v)


def rows(df_rows):
    return sorted([tuple(map(plain, r)) for r in df_rows], key=str)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(plans.oracle(plans.SQL[name]))
    assert columns == sorted(expected.columns)
    want = expected.select(*[f'"{c}"' for c in columns]).fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_queries_without_sql_have_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
