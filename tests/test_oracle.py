"""Every SQL-checked query against its DuckDB oracle (sf0.001), plus the
driver contract."""

import math

import duckdb
import pytest

import __spark_entry__ as ent

SF001 = "/root/testdata/sf0.001"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SQL = ent.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _canon(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    got = _canon(ent.queries()[name](spark, SF001).toPandas())
    exp = _canon(con.sql(SQL[name]).df())
    assert got[0] == exp[0]
    assert len(got[1]) == len(exp[1])
    assert got[1] == exp[1]


def test_contract(spark):
    qs = ent.queries()
    assert set(SQL) <= set(qs)
    df = ent.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "flight_id" and "ROUTE_DELAY_RATE_15" in df.columns
