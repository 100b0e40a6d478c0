"""Every registered query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from parallaxis.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def comparable(frame, columns):
    cell = lambda v: None if v is None or v != v else round(float(v), 4) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(map(cell, row)) for row in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "lineitem", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found, expected = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    assert comparable(found, columns) == comparable(expected, columns)
