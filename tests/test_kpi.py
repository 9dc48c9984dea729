import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crossbasket.operators import kpi, profile
from crossbasket.operators.kpi import Chain


@pytest.fixture
def chain(spark):
    sales = spark.createDataFrame(
        [
            ("u1", "o1", "10.00", 2, "skin", "Alpha", "s1", 1),
            ("u1", "o1", "20.00", 1, "hair", "Beta", "s1", 1),
            ("u1", "o2", "30.00", 3, "skin", "Alpha", "s2", 1),
            ("u2", "o3", "40.00", 4, None, "Alpha", "s2", 1),
            ("u3", "o4", "99.00", 9, "skin", "Beta", "s1", 0),
            (None, "o5", "1.00", 1, "skin", None, "s1", 0),
        ],
        "vip string, order string, amt string, qty int, arti_cate_name string, brand string,"
        " shop string, shared int",
    ).withColumn("amt", F.col("amt").cast("decimal(18,4)"))
    members = spark.createDataFrame(
        [
            ("u1", "Gold", dt.date(2001, 6, 1), 1),
            ("u2", "Basic", dt.date(1998, 1, 1), 1),
            ("u4", "Gold", dt.date(1990, 1, 1), 1),
            ("u5", "Odd", None, 1),
            ("u6", "Gold", dt.date(2002, 6, 1), 1),
            ("u3", "Gold", dt.date(2001, 6, 1), 0),
        ],
        "vip string, tier string, first_purchase date, shared int",
    )
    return Chain("x", sales, members, "vip", "order")


@pytest.fixture
def other(chain):
    return Chain("y", chain.sales.filter("qty < 4"), chain.members, "vip", "order")


def test_single_figures(spark, chain):
    n = spark.createDataFrame([(4,)], "n bigint")
    assert kpi.aov(chain, "shared").first()[0] == round(100 / 3, 4)
    assert kpi.upt(chain, "shared").first()[0] == round(10 / 3, 4)
    assert kpi.avg_price_point(chain, "shared").first()[0] == 10.0
    assert kpi.avg_trans_per_cust(chain, "shared", n).first()[0] == 0.75
    assert kpi.avg_spend_per_cust(chain, "shared", n).first()[0] == 25.0


def test_figures_of_nobody_are_missing(spark, chain):
    empty = Chain("x", chain.sales.filter("amt > 1000"), chain.members, "vip", "order")
    zero = spark.createDataFrame([(0,)], "n bigint")
    assert kpi.aov(empty, "shared").first()[0] is None
    assert kpi.avg_price_point(empty, "shared").first()[0] is None
    assert kpi.avg_spend_per_cust(empty, "shared", zero).first()[0] is None


def test_sales_behavior_agrees_with_the_single_figures(spark, chain, other):
    n = spark.createDataFrame([(4,)], "n bigint")
    table = kpi.sales_behavior(chain, other, "shared", "shared", n)
    got = {(r["side"], r["metric"]): r["value"] for r in table.collect()}
    assert len(got) == 12
    assert {r["pair"] for r in table.collect()} == {"x_y"}
    for side in (chain, other):
        assert got[side.name, "n_customers"] == 4.0
        assert got[side.name, "aov"] == kpi.aov(side, "shared").first()[0]
        assert got[side.name, "upt"] == kpi.upt(side, "shared").first()[0]
        spend = kpi.avg_spend_per_cust(side, "shared", n).first()[0]
        assert got[side.name, "avg_spend_per_cust"] == spend


def test_penetration_counts_missing_customers_as_one(chain):
    row = kpi.overlap_penetration(chain, "shared").first()
    assert (row["n_overlap"], row["n_all"], row["penetration"]) == (2, 4, 0.5)


def test_tenure_share(chain):
    got = {r[0]: r[1] for r in kpi.tenure_share(chain, "shared", "2001-12-31").collect()}
    # of five members: half a year and a negative tenure, nearly four years, twelve, unknown
    assert got == {
        "tenure1-2": 40.0,
        "tenure3-4": 20.0,
        "tenure5-6": 0.0,
        "tenure7-8": 0.0,
        "tenure>8": 20.0,
    }


def test_demo_table(chain, other):
    table = kpi.demo_table(chain, other, "shared", "shared", "2001-12-31")
    got = {(r["side"], r["metric"]): r["pct"] for r in table.collect()}
    assert len(got) == 12
    assert got["x", "overlap_customers"] == 50.0


def test_share_of_wallet(chain, other):
    rows = kpi.share_of_wallet(chain, other, "shared", "shared").collect()
    got = {r["side"]: (r["sales"], r["share_pct"]) for r in rows}
    assert got == {"x": (100.0, 62.5), "y": (60.0, 37.5)}
    nobody = Chain("y", other.sales.filter("amt > 1000"), other.members, "vip", "order")
    rows = kpi.share_of_wallet(chain, nobody, "shared", "shared").collect()
    assert {r["side"]: r["share_pct"] for r in rows} == {"x": None, "y": None}


def test_tier_percent_in_display_order(chain):
    got = kpi.tier_percent(chain, "shared", ["Basic", "Gold"]).collect()
    assert [tuple(r) for r in got] == [
        ("Basic", 1, 0.2, 1),
        ("Gold", 3, 0.6, 2),
        ("Odd", 1, 0.2, None),
    ]


def test_price_points(chain, other, rows):
    got = kpi.pricepoint_by_cat(chain.overlapping("shared"))
    assert rows(got) == [
        ("hair", 20.0, 1.0, 20.0),
        ("skin", 40.0, 5.0, 8.0),
        (None, 40.0, 4.0, 10.0),
    ]
    table = kpi.pricepoint_table(chain, other, "shared", "shared")
    assert rows(table) == [("hair", 20.0, 20.0), ("skin", 8.0, 8.0), (None, 10.0, None)]


def test_rankings_break_ties_by_name(chain):
    top = profile.top_by(chain.overlapping("shared"), "brand", "vip").collect()
    assert [tuple(r) for r in top] == [("Alpha", 2, 100.0), ("Beta", 1, 50.0)]
    assert profile.top_by(chain.sales, "shop", "vip", 1).collect()[0]["shop"] == "s1"
    by = profile.customers_by(chain.sales, ["shop", "brand"], "vip").collect()
    assert [tuple(r) for r in by] == [
        ("s1", "Beta", 2),
        ("s2", "Alpha", 2),
        ("s1", "Alpha", 1),
        ("s1", None, 0),
    ]


def test_customers_by_order_content(spark, chain):
    raw = spark.createDataFrame(
        [("o1", "a"), ("o1", "a"), ("o1", "b"), ("o3", "a"), ("o4", "c")], "order string, c string"
    )
    lines = chain.overlapping("shared")
    got = profile.customers_by_order_content(lines, raw, "order", ["c"], "vip").collect()
    assert [tuple(r) for r in got] == [("a", 2), ("b", 1), (None, 1)]


def test_shares(chain, rows):
    shares = profile.sow_by(chain.overlapping("shared"), "brand")
    assert rows(shares) == [("Alpha", 80.0, 0.8), ("Beta", 20.0, 0.2)]
    both = profile.sow_by_both(shares, profile.sow_by(chain.sales, "brand"), "brand")
    assert rows(both) == [
        ("Alpha", 0.8, 0.4),
        ("Beta", 0.2, 0.595),
        (None, None, 0.005),
    ]
    assert sum(r["pct"] for r in profile.sow_by(chain.sales, "shop").collect()) == 1
    assert rows(profile.spend_by(chain.sales, ["shop", "shared"])) == [
        ("s1", 0, 100.0),
        ("s1", 1, 30.0),
        ("s2", 1, 70.0),
    ]


def test_counts_by_value_and_store(chain, rows):
    assert rows(profile.value_counts(chain.sales, "brand")) == [("Alpha", 3), ("Beta", 2)]
    stores = profile.penetration_by_store(chain.sales, "shop", "shared", 1).collect()
    assert [tuple(r) for r in stores] == [("s2", 1.0)]


def test_brand_info(spark, rows):
    df = spark.createDataFrame(
        [
            ("A", "m1", "t1", dt.date(1998, 1, 1)),
            ("A", "m1", "t2", dt.date(1999, 1, 1)),
            ("A", None, "t2", dt.date(1999, 2, 1)),
        ],
        "b string, m string, t string, d date",
    )
    got = profile.brand_info(df, "b", "m", "t", "d")
    assert rows(got) == [("A", 1, 2, dt.date(1998, 1, 1), dt.date(1999, 2, 1))]
    by_year = profile.brand_info(df, "b", "m", "t", "d", by_year=True)
    assert [(r["year"], r["n_trans"]) for r in by_year.orderBy("year").collect()] == [
        (1998, 1),
        (1999, 1),
    ]


def test_listings(chain, rows):
    got = profile.distinct_values(chain.sales, ["brand"], F.col("shop") == "s1")
    assert rows(got) == [("Alpha",), ("Beta",), (None,)]
    assert [r[0] for r in profile.sorted_values(chain.sales, "brand").collect()] == [
        None,
        "Alpha",
        "Beta",
    ]


def test_order_parts_count_each_order_once_for_each_condition(spark):
    rng = random.Random(1)
    lines = [
        (rng.choice([None, "o1", "o2", "o3", "o4"]), rng.random() < 0.5, rng.random() < 0.3, rng.randint(1, 9), 1)
        for _ in range(40)
    ]
    sales = spark.createDataFrame(lines, "o string, x boolean, y boolean, amt long, qty long")
    conditions = [F.col("x"), F.col("y"), F.col("x") & F.col("y"), F.lit(False)]
    parts = kpi.order_parts(sales, "o", conditions)
    got = {r["name"]: tuple(r)[1:] for r in kpi.order_totals(parts, {"x": 0, "y": 1, "both": 2, "none": 3}).collect()}

    def expected(met):
        kept = [line for line in lines if met(line)]
        return sum(line[3] for line in kept) or None, len(kept) or None, len({line[0] for line in kept} - {None})

    assert got == {
        "x": expected(lambda r: r[1]), "y": expected(lambda r: r[2]), "both": expected(lambda r: r[1] and r[2]),
        "none": (None, None, 0),
    }


def test_counts_and_sums_by_mask(spark):
    rows = [("k1", "c", 1, True), ("k1", None, 2, False), (None, "c", 3, True), ("k2", "d", 4, None), ("k3", "c", 5, False)]
    df = spark.createDataFrame(rows, "k string, dim string, amt long, flag boolean").withColumn("qty", F.lit(1))
    conditions = {"flag": F.col("flag"), "all": F.lit(True), "big": F.col("amt") > 3, "never": F.lit(None).cast("boolean")}
    got = {r["name"]: r["n"] for r in kpi.count_keys_by_mask(df, "k", conditions).collect()}
    assert got == kpi.count_keys_if(df, "k", conditions).first().asDict() == {"flag": 2, "all": 4, "big": 2, "never": 0}
    assert {r["n"] for r in kpi.count_keys_by_mask(df.limit(0), "k", conditions).collect()} == {0}
    sums = {(r["name"], r["dim"]): (r["amt"], r["qty"]) for r in kpi.sums_by_mask(df, "dim", conditions).collect()}
    assert sums == {
        ("flag", "c"): (4, 2), ("all", "c"): (9, 3), ("all", None): (2, 1), ("all", "d"): (4, 1),
        ("big", "d"): (4, 1), ("big", "c"): (5, 1),
    }
