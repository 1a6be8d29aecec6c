"""Every registered query against its SQL in DuckDB on the small tables."""

import duckdb
import pytest

from evidencelens import catalog
from evidencelens.compare import TABLES, compare_query
from tests.conftest import SMALL

catalog.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = compare_query(spark, duck, catalog.QUERIES[name], catalog.SQL.get(name), SMALL)
    assert result.startswith("ok") or (result == "EMPTY" and name == "complete_case"), result


def test_inventory_is_covered():
    have = {i for ids in catalog.IDS.values() for i in ids.split()}
    sizes = dict(S=12, P=16, J=15, A=37, M=14, E=23, K=12, T=7, F=14, V=18, R=3, L=17, U=1)
    assert {f"{p}{i}" for p, n in sizes.items() for i in range(1, n + 1)} <= have


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.count() == spark.read.parquet(f"{SMALL}/events.parquet").count()
