import pytest
from pyspark.sql import functions as F

from crossbasket.operators import stores

SHOPS = ["s1", "s2"]


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [
            ("m1", "s1", 0, 0, 1),
            ("m1", "s9", 0, 1, 0),
            ("m2", "s2", 1, 0, 1),
            ("m3", "s9", 0, 0, 0),
            ("m4", None, 0, 0, 1),
            (None, "s1", 0, 0, 1),
            ("m9", "s1", 0, 0, 1),
        ],
        "m string, shop string, a int, b int, y int",
    )


@pytest.fixture
def issue(spark):
    return spark.createDataFrame(
        [("m1", "s9"), ("m1", "s9"), ("m2", "s1"), ("m3", "s9"), ("m4", "s9"), ("m5", "s1"),
         ("m1", "s1"), (None, "s1"), ("m6", None)],
        "no string, loc string",
    )


def test_store_in_out(sales):
    row = stores.store_in_out(sales, "m", "shop", SHOPS).first()
    assert (row["n_inside"], row["n_both"]) == (3, 1)


def test_shared_customers(sales, rows):
    inside = F.col("shop").isin(*SHOPS)
    got = stores.shared_customers(sales.filter(inside), sales.filter(~inside), "m")
    assert rows(got) == [("m1",)]


def test_store_lookup(spark, sales, rows):
    dim = spark.createDataFrame([("s1", "One")], "store_id string, store_name string")
    assert rows(stores.store_lookup(sales, dim, "shop")) == [
        ("s1", "One"),
        ("s2", None),
        ("s9", None),
        (None, None),
    ]
    named = stores.with_store(sales, dim, "shop", "store_name")
    assert named.filter("store_name = 'One'").count() == 3


def _literal(spark, sales, issue, on, where="TRUE"):
    sales.createOrReplaceTempView("s")
    issue.createOrReplaceTempView("i")
    return spark.sql(
        f"SELECT count(DISTINCT m) FROM s RIGHT JOIN i ON m = no AND {on} WHERE {where}"
    ).first()[0]


def test_issue_right_join_in_condition_or_after(spark, sales, issue):
    got = stores.issue_right_join(issue, sales, "no", "loc", "m", SHOPS, F.col("y") == 1).first()
    at_shops = "loc IN ('s1', 's2')"
    assert got["n_listed"] == 6
    assert got["n_sold"] == _literal(spark, sales, issue, "TRUE")
    assert got["n_sold_at_shops"] == _literal(spark, sales, issue, at_shops)
    assert got["n_sold_at_shops"] == _literal(spark, sales, issue, "TRUE", at_shops)
    assert got["n_sold_at_shops_in_window"] == _literal(
        spark, sales, issue, "TRUE", f"y = 1 AND {at_shops}"
    )


def test_issue_counts_equal_right_joins(spark, sales, issue):
    got = {
        r["case"]: r["n_members"]
        for r in stores.issue_counts(
            issue, sales, "no", "loc", "m", "shop", SHOPS, ["a", "b"]
        ).collect()
    }
    joined = {"in": "loc IN ('s1', 's2')", "out": "loc NOT IN ('s1', 's2')"}
    shopped = {"in": "shop IN ('s1', 's2')", "out": "shop NOT IN ('s1', 's2')"}
    assert got["n_buyers"] == _literal(spark, sales, issue, "TRUE")
    assert got["joined_out"] == _literal(spark, sales, issue, joined["out"])
    for j in ("in", "out"):
        for s in ("in", "out"):
            expected = _literal(spark, sales, issue, f"{joined[j]} AND {shopped[s]}")
            assert got[f"joined_{j}_shop_{s}"] == expected
        halves = [
            f"SELECT DISTINCT m FROM s JOIN i ON m = no AND {joined[j]} AND {shopped[s]}"
            for s in ("in", "out")
        ]
        both = spark.sql(" INTERSECT ".join(halves)).count()
        assert got[f"joined_{j}_shop_both"] == both
    assert got["joined_out_unlabelled"] == _literal(
        spark, sales, issue, f"{joined['out']} AND a = 0 AND b = 0"
    )
