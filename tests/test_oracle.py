"""Every registered query against its SQL twin on DuckDB."""

import datetime as dt
import decimal
import os

import pytest

import __spark_entry__ as driver
from crossbasket.plans.oracle import PREFIX, oracle_queries
from crossbasket.plans.queries import registered

duckdb = pytest.importorskip("duckdb")

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime) and value.time() == dt.time(0):
        return value.date()
    return value


def _sorted(found):
    return sorted(found, key=lambda row: [(v is None, str(v)) for v in row])


def test_every_query_has_a_twin():
    assert set(registered()) == set(oracle_queries())
    assert set(registered()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_equals_its_twin(spark, duck, name):
    df = registered()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(_plain(row[c]) for c in columns) for row in df.collect()]
    cursor = duck.execute(oracle_queries()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()]
    assert _sorted(got) == _sorted(expected)


def test_the_roles_hold_the_hard_cases():
    """Pairs on both contacts, brand buyers with several matches, repeated and second codes."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables of that size")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")

    def one(select):
        return connection.execute(PREFIX + select).fetchall()[0][0]

    both = "SELECT COUNT(*) FROM pair_a_b WHERE a_email = b_email AND a_mobile = b_mobile AND a_mobile <> ''"
    assert one(both) > 0
    assert one("SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM pair_brand GROUP BY ak)") >= 2
    assert one("SELECT COUNT(*) - COUNT(DISTINCT item_subcat_desc || arti_cate_code) FROM map_c") > 0
    codes = "SELECT MAX(n) FROM (SELECT COUNT(DISTINCT arti_cate_code) AS n FROM map_c GROUP BY item_subcat_desc)"
    assert one(codes) == 2
    connection.close()


def test_entry(spark):
    if not os.path.isdir(driver.SMALLEST):
        pytest.skip("no smallest tables")
    df = driver.entry(spark)
    assert df.columns == ["aov"]
    assert df.count() == 1
