import duckdb
import pandas as pd
import pytest

from heliograph.llm import queries

WHERE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{WHERE}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, WHERE).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)


def test_edge_rows_equal_sql(spark, edge_docs):
    con = duckdb.connect()
    con.register("documents", edge_docs.select("doc_id", "text").where("doc_id IS NOT NULL").distinct().toPandas())
    from heliograph.llm import quality_rules, sql

    want = con.sql(sql.quality_sql()).df()
    got = quality_rules.apply_rules(edge_docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct()).drop("cleaned_text").toPandas()
    key = ["doc_id", "n_words"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want[got.columns].sort_values(key).reset_index(drop=True), check_dtype=False)
