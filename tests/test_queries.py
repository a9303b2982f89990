"""Every query with SQL, on both engines, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillspan import registry

DIR = "/root/testdata/sf0.001"
TABLES = ["customer", "part", "orders", "lineitem", "nation", "documents", "pages"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):  # noqa: ANN001, ANN202
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got, want = registry.queries()[name](spark, DIR).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
