import datetime as dt

import pytest
from pyspark.sql import functions as F

from crossbasket.functions.text import category_default
from crossbasket.operators import members, sales
from crossbasket.operators.sales import scope


def test_valid_transactions(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, None), (2, 1, "V"), (3, 0, None), (4, None, None)],
        "id int, valid_tx_flag int, void_flag string",
    )
    assert rows(sales.valid_transactions(df).select("id")) == [(1,)]


def test_scope_is_inclusive_and_skips_bad_dates(spark, rows):
    data = [("1998-03-31", "HK"), ("1998-04-01", "HK"), ("1999-03-31", "IH"), ("1999-04-01", "HK"),
            ("junk", "HK"), (None, "HK"), ("1998-05-01", "TW"), ("1998-05-01", None)]
    df = spark.createDataFrame(data, "d string, r string")
    got = scope(df, "d", "1998-04-01", "1999-03-31", "r", ["HK", "IH"])
    assert rows(got) == [("1998-04-01", "HK"), ("1999-03-31", "IH")]
    typed = df.withColumn("d", F.col("d").try_cast("date"))
    got = scope(typed, "d", dt.date(1998, 4, 1), dt.date(1999, 3, 31))
    assert got.count() == 4


def test_brand_and_segment_filters_drop_nulls(spark, rows):
    df = spark.createDataFrame([("ABC",), ("xyz",), (None,)], "b string")
    assert rows(sales.exclude_brand(df, "b", "AB")) == [("xyz",)]
    assert rows(sales.segment(df, "b", ["ABC"])) == [("ABC",)]
    assert rows(sales.segment(df, "b", ["ABC"], negate=True)) == [("xyz",)]


def test_latest_per_key_keeps_ties_and_drops_undated(spark, rows):
    data = [
        ("a", 1, dt.date(2000, 1, 1)),
        ("a", 2, dt.date(2000, 1, 2)),
        ("a", 3, dt.date(2000, 1, 2)),
        ("a", 3, dt.date(2000, 1, 2)),
        ("b", 1, None),
        (None, 1, dt.date(2000, 1, 1)),
        ("c", 1, dt.date(1999, 1, 1)),
        ("c", 2, None),
    ]
    df = spark.createDataFrame(data, "k string, v int, d date")
    got = sales.latest_per_key(df, "k", "d").select("k", "v")
    assert rows(got) == [("a", 2), ("a", 3), ("c", 1)]


def test_resolve_member(spark, rows):
    mapped = spark.createDataFrame(
        [("v1", "D"), ("v1", "C"), ("v1", None), ("v2", None)], "no string, main string"
    )
    assert rows(sales.resolve_member(mapped, "no", "main")) == [("v1", "C")]
    lines = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "no string")
    got = sales.enrich_member(lines, mapped, "no", "main")
    assert rows(got) == [("v1", "C"), ("v2", "v2"), ("v3", "v3")]


@pytest.fixture
def keyed(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")


@pytest.mark.parametrize("keys", [["a"], ["a", None], [], [None], ["z"]])
def test_exclude_carveout_is_sql_not_in(spark, keyed, rows, keys):
    listed = spark.createDataFrame([(k,) for k in keys], "k string")
    keyed.createOrReplaceTempView("lines")
    listed.createOrReplaceTempView("listed")
    expected = spark.sql("SELECT * FROM lines WHERE k NOT IN (SELECT k FROM listed)")
    assert rows(sales.exclude_carveout(keyed, listed, "k")) == rows(expected)
    inside = spark.sql("SELECT * FROM lines WHERE k IN (SELECT k FROM listed)")
    assert rows(sales.carveout_semi(keyed, listed, "k")) == rows(inside)


def test_mark_carveout(spark, keyed, rows):
    listed = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(sales.mark_carveout(keyed, listed, "k")) == [
        ("a", 1, 1),
        ("a", 2, 1),
        ("b", 3, 0),
        (None, 4, None),
    ]


def test_carveout_keys_on_the_odd_date(spark, rows):
    day, other = dt.date(1998, 5, 1), dt.date(1998, 5, 2)
    line = ("JB", "HK", "1", day, "1998-05-01 pos", 1, None)

    def changed(key, **values):
        names = ["shop_brand", "region_key", "item_code", "order_date", "invoice_remark",
                 "valid_tx_flag", "void_flag"]
        return (key, *[values.get(n, v) for n, v in zip(names, line)])

    data = [
        changed("odd, remarked"),
        changed("odd, remarked"),
        changed("odd, other remark", invoice_remark="manual"),
        changed("odd, no remark", invoice_remark=None),
        changed("other date", order_date=other, invoice_remark=None),
        changed("no date", order_date=None),
        changed("other chain", order_date=other, shop_brand="IX"),
        changed("other region", order_date=other, region_key="TW"),
        changed("dummy", order_date=other, item_code="7"),
        changed("void", order_date=other, void_flag="V"),
        changed("invalid", order_date=other, valid_tx_flag=0),
    ]
    schema = ("sales_main_key string, shop_brand string, region_key string, item_code string,"
              " order_date date, invoice_remark string, valid_tx_flag int, void_flag string")
    df = spark.createDataFrame(data, schema)
    got = sales.carveout_keys(df, "JB", "HK", "1998-05-01", "7")
    assert rows(got) == [("odd, remarked",), ("other date",)]


def test_carveout_sales_keeps_unsold_keys(spark, rows):
    lines = spark.createDataFrame(
        [("k1", "soap", "own", 5), ("k1", "pen", "own", 6), ("k9", "soap", "own", 7)],
        "sales_main_key string, item_subcat_desc string, arti_cate_name string, amt int",
    )
    keys = spark.createDataFrame([("k1",), ("k2",)], "sales_main_key string")
    mapping = spark.createDataFrame(
        [("soap", "Care")], "item_subcat_desc string, arti_cate_name string"
    )
    got = sales.carveout_sales(lines, keys, mapping).select(
        "sales_main_key", "item_subcat_desc", "arti_cate_name", "amt"
    )
    assert rows(got) == [
        ("k1", "pen", None, 6),
        ("k1", "soap", "Care", 5),
        ("k2", None, None, None),
    ]


def test_order_line_rejoin_weighs_like_the_plain_join(spark):
    lines = spark.createDataFrame([("o1", 5), ("o1", 7), ("o2", 1), ("o9", 2)], "o string, amt int")
    raw = spark.createDataFrame(
        [("o1", "x"), ("o1", "x"), ("o1", "y"), ("o2", None)], "o string, c string"
    )
    plain = lines.join(raw, ["o"], "left").groupBy("c").agg(F.sum("amt"), F.count(F.lit(1)))
    got = sales.order_line_rejoin(lines, raw, "o", "c").groupBy("c").agg(
        F.sum(F.col("amt") * F.col("copies")), F.sum("copies")
    )
    assert set(map(tuple, got.collect())) == set(map(tuple, plain.collect()))


@pytest.fixture
def dims(spark):
    brands = spark.createDataFrame([("B1 ", "Brand one")], "brand_code string, brand_desc string")
    skus = spark.createDataFrame(
        [("i1", "c1", "one"), ("i1", "c1", "uno"), ("i2", "c2", "two")],
        "item_code string, item_cat string, item_desc string",
    ).withColumn("brand_code", F.lit("B1")).withColumn("last_modified_date", F.current_date())
    member_map = spark.createDataFrame([("v1", "m1")], "vip_no string, vip_main_no string")
    shops = spark.createDataFrame([("s1", "Shop")], "shop_code string, shop_desc string")
    cats = spark.createDataFrame([("c1", "SKIN")], "maincat_code string, maincat_desc string")
    mapping = spark.createDataFrame(
        [("SKIN", "Skincare", "WW")], "maincat_desc string, arti_cate_name string, bu_desc string"
    )
    return brands, skus, member_map, shops, cats, mapping


@pytest.mark.parametrize("match", [True, False])
def test_enrich_sales_b(spark, dims, rows, match):
    lines = spark.createDataFrame(
        [
            (" B1", "i1", "v1", "s1", "n1", 1, None),
            (" B1", "i1", "v1", "s1", "n1", 1, None),
            ("ZZ", "i1", "v2", "s1", "n2", 1, None),
            ("B1", "i2", "v1", "s9", "n3", 1, None),
            ("B1", "i2", "v1", "s9", "n4", 0, None),
        ],
        "prod_brand string, item_code string, vip_no string, shop_code string,"
        " invoice_no string, valid_tx_flag int, void_flag string",
    )
    got = sales.enrich_sales_b(lines, *dims, sku_brand_match=match).select(
        "sales_main_key", "vip_main_no", "brand_desc", "item_desc", "shop_desc", "arti_cate_name",
        "bu_desc",
    )
    unknown = [("s1-n2", "v2", None, None, "Shop", "others", None)]
    if not match:
        unknown = [
            ("s1-n2", "v2", None, "one", "Shop", "Skincare", "WW"),
            ("s1-n2", "v2", None, "uno", "Shop", "Skincare", "WW"),
        ]
    assert rows(got) == [
        ("s1-n1", "m1", "Brand one", "one", "Shop", "Skincare", "WW"),
        ("s1-n1", "m1", "Brand one", "uno", "Shop", "Skincare", "WW"),
        *unknown,
        ("s9-n3", "m1", "Brand one", "two", None, "others", None),
    ]


def test_enrich_sales_a(spark, rows):
    lines = spark.createDataFrame(
        [("1", "COS", "S"), ("1", "HL", "S"), ("9", "COS", "Z"), ("9", "COS", "Z")],
        "loc_code string, bu_desc string, category_desc string",
    )
    stores = spark.createDataFrame(
        [("1 ", "ASIA", "One")], "store_id string, vat_region_name string, store_name string"
    )
    mapping = spark.createDataFrame([("S", "Skin")], "category_desc string, arti_cate_name string")
    got = sales.enrich_sales_a(lines, stores, mapping)
    picked = got.select("loc_code", "bu_desc", "vat_region_name", "arti_cate_name")
    assert rows(picked) == [
        ("1", "COS", "ASIA", "Skin"),
        ("1", "HL", "ASIA", "HL"),
        ("9", "COS", None, "others"),
    ]
    every = sales.enrich_sales_a(lines, stores, mapping, unit_value=None)
    assert rows(every.select("bu_desc", "arti_cate_name")) == [
        ("COS", "Skin"),
        ("COS", "others"),
        ("HL", "Skin"),
    ]


def test_brand_code_lookup(spark, rows):
    lines = spark.createDataFrame([(" B1",), ("B1 ",), ("B2",), (None,)], "prod_brand string")
    brands = spark.createDataFrame([("B1  ", "One")], "brand_code string, brand_desc string")
    assert rows(sales.brand_code_lookup(lines, brands)) == [
        ("B1", "One"),
        ("B2", None),
        (None, None),
    ]


def test_active_members(spark, rows):
    known = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, v int")
    lines = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "k string")
    assert rows(members.active_members(known, lines, "k")) == [("a", 1)]


def test_golden_records(spark):
    schema = ("vip_no string, email string, phone_no string, sex string, birth_date string,"
              " card_type string, join_bu_desc string, card_start_date string,"
              " first_transaction_date string, country_of_residence string")
    data = [
        ("3a", "B@x.com", "+852-1", None, None, "Tracking", "COS", "3999-12-31", "1999-01-01", "P"),
        ("3a", "a@x.com ", None, "F", "1960-01-01", "Diamond", "HL", "1990-06-15", "junk", None),
        ("3b", None, None, None, None, None, None, None, None, None),
    ]
    got = {r["vip_no"]: r for r in members.golden_record_a(spark.createDataFrame(data, schema)).collect()}
    first = got["3a"].asDict()
    assert first == {
        "vip_no": "3a", "mobile": "1", "email": "a@x.com", "sex": "F", "birth_date": "1960-01-01",
        "card_start_date": "1999-12-31", "join_bu_desc": "HL", "first_purchase": None,
        "tier": "Diamond", "nationality": "P",
    }
    assert got["3b"]["mobile"] == "" and got["3b"]["email"] is None

    schema = ("vip_main_no string, vip_email string, vip_tel_2 string, vip_sex string,"
              " vip_type string, vip_birth_iyy string, vip_birth_imm string, vip_birth_idd string,"
              " vip_first_pur_date string, vip_issue_date string, region_key string")
    data = [
        ("m1", "X@y", "8525", "M", "0", "1960", "1", "1", "1999-01-01", None, "HK"),
        ("m1", None, "", "F", "3", "1950", "9", "10", "2000-01-01", "2000-02-02", "TW"),
        ("m2", None, None, None, "5", None, None, None, None, None, "HK"),
    ]
    types = spark.createDataFrame(
        [("0", "ICARD Gold", "HK"), ("0", "OLD", "TW"), ("3", "STAFF", "HK"), ("5", "OLD", "TW")],
        "viptyp_code string, viptyp_desc string, region_key string",
    )
    df = spark.createDataFrame(data, schema)
    only = members.golden_record_b(df, types, "HK").collect()
    assert [r["vip_main_no"] for r in only] == ["m1"]
    row = only[0]
    assert (row["mobile"], row["email"], row["tier"]) == ("5", "x@y", "ICARD Gold")
    assert (row["sex"], row["birth_day"], row["nationality"]) == ("M", "10", "TW")
    assert row["first_purchase"] == dt.date(2000, 1, 1)
    ranked = members.golden_record_b(df, types, "HK", tier_order=["OTHERS", "ICARD Gold"]).first()
    assert ranked["tier"] == "OTHERS"


def test_no_aggregate_stands_above_the_joins(spark, dims):
    lines = spark.createDataFrame([], "vip_no string, shop_code string, invoice_no string, prod_brand string, item_code string, valid_tx_flag int, void_flag string, amt long")
    plan = sales.enrich_sales_b(lines, *dims)._jdf.queryExecution().analyzed().toString()
    assert "Distinct" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")]


def test_repeated_lookup_rows_repeat_no_line(spark, rows):
    lines = spark.createDataFrame(
        [("s1", "soap", "COS", 1)] * 3 + [("s1", "soap", "WW", 1), ("s9", None, "COS", 2)],
        "loc_code string, category_desc string, bu_desc string, amt int",
    )
    stores = spark.createDataFrame([("s1 ", "north"), ("s1", "north"), ("s1", "south")], "store_id string, region string")
    mapping = spark.createDataFrame([("soap", "Care"), ("soap", "Care"), ("soap", None), ("soap", "Bath")], "category_desc string, arti_cate_name string")
    got = sales.enrich_sales_a(lines, stores, mapping)
    literal = (
        lines.join(stores.selectExpr("trim(store_id) AS loc_code", "region"), ["loc_code"], "left")
        .join(mapping, ["category_desc"], "left")
        .withColumn("arti_cate_name", category_default(F.col("arti_cate_name"), F.col("bu_desc"), "COS"))
        .distinct()
    )
    assert rows(got.select(*literal.columns)) == rows(literal)
    assert got.count() == 2 * 3 + 2 + 1
