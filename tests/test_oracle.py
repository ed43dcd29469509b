"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import VIEWS, canon

from .conftest import SF_SMALL

SQL = E.oracle_sql()
# Spark type name -> DuckDB type name (decimals compare as DECIMAL(p,s) on both sides)
DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR",
             "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in VIEWS:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert canon(df.columns, rows) == canon(dcols, drows)
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    for col, t in df.dtypes:
        assert DUCK_TYPE.get(t, t.upper()) == duck_types[col], (col, t, duck_types[col])


def test_entry_contract(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["chain_name", "active_bookings"]
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", ["payments_board", "row_policy"])
def test_timestamps_independent_of_session_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Toronto")
    try:
        df = E.queries()[name](spark, SF_SMALL)
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    res = con.execute(SQL[name])
    assert canon(df.columns, rows) == canon([d[0] for d in res.description], res.fetchall())
