"""The entry points, and all queries that have SQL on the smallest tables where these are at hand."""

import os

import pytest

import __spark_entry__
from kilnwork.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql_but_the_approximate_one():
    assert set(QUERIES) - set(SQL) == {"vector_search_probed"}
    assert set(SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["split_pdf_tag", "markup_to_text", "chunk_ids", "chat_history", "bm25_search"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = con.sql(SQL[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*expected.columns).collect()))) == sorted(map(str, expected.fetchall()))


def test_plans_push_down(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    plan = QUERIES["orphan_pages"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(source)" in plan and "html" not in plan
