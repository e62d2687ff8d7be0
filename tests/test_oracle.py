"""Every registered query with an SQL oracle, on the smallest test tables,
against DuckDB (the driver runs the same check at sf0.01)."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(repr(_norm(x)) for x in rec)
                        for rec in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _names():
    import __spark_entry__ as entry
    return sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_duckdb(spark, con, name):
    import __spark_entry__ as entry
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert r1 == r2
