"""Every registered telemetry query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from heliograph.plans import queries, source_queries  # noqa: F401

WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{WHERE}/{name}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    show = lambda v: "null" if pd.isna(v) else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, WHERE).toPandas()
    if name in queries.SQL:
        want = con.sql(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert queries.QUERIES.keys() <= driver.queries().keys() and driver.oracle_sql().keys() <= driver.queries().keys()
