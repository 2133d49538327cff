"""Registered queries against their SQL in DuckDB."""

import duckdb
import pytest

from threadlens.llm import queries

from ..compare import compared

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert compared(spark, duckdb.connect(), queries.QUERIES[name], queries.SQL[name], SF)


def test_op4_draws_from_the_whole_table(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = queries.QUERIES["op4_resample"](spark, SF).collect()
    assert 0 < len(got) <= n and all(r.kept for r in got)
