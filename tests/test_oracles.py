"""Every registered query equals its DuckDB oracle (row count, columns, value hash)."""

import duckdb
import pytest

import __spark_entry__ as E
from funnelworks.plans.catalog import ORACLES, QUERIES
from funnelworks.sources.tables import TABLES, table_path
from tests.conftest import SMOKE_DIR
from tools.oracle_check import digest


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SMOKE_DIR, t)}')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= E.queries().items() and ORACLES.items() <= E.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMOKE_DIR)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:4] == ["category", "event_day", "classification", "brand"]
    assert df.count() > 0
