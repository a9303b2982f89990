"""The registered queries against their SQL."""

import duckdb
import pytest

from quillspan.llm import queries

from .fixtures import DATA, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, *want.columns) == sorted(want.fetchall(), key=repr)
