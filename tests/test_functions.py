import datetime as dt

import pytest
from pyspark.sql import functions as F

from crossbasket.functions import (
    card_date_sentinel,
    category_default,
    cleanse_phone,
    display_rank,
    labelled,
    normalise_email,
    order_date_format,
    tenure_group,
    tenure_years,
    tier_whitelist,
    transaction_key,
    trim_all,
    update_tier,
)
from crossbasket.functions.dates import tenure_labels
from crossbasket.functions.tiers import FASHION_TIERS

PHONES = {
    None: "",
    "": "",
    " 91234567 ": "91234567",
    "\t91234567\n": "91234567",
    " 91234567　": "91234567",
    "\x1c91234567\x1f": "91234567",
    "+852-91234567": "91234567",
    "+85291234567": "91234567",
    "8529123": "9123",
    "+8613800": "13800",
    "+85286123": "123",
    "+86852123": "123",
    "86123456": "123456",
    "852852": "852",
    "8686": "86",
    "a-b-c": "c",
    "123-": "",
    "12- 852": " 852",
    "12-852": "",
    "+86+852": "+852",
}


def test_cleanse_phone(spark):
    df = spark.createDataFrame([(p,) for p in PHONES], "phone string")
    got = {r[0]: r[1] for r in df.select("phone", cleanse_phone(F.col("phone"))).collect()}
    assert got == PHONES


def test_cleanse_phone_against_plain_python(spark):
    """Every combination of the pieces a number can start with."""
    pieces = ["", "+852", "+86", "852", "86", "-", " "]
    phones = [a + b + c + "5" for a in pieces for b in pieces for c in pieces]

    def expected(phone):
        phone = phone.strip().split("-")[-1]
        for prefix in ("+852", "+86", "852", "86"):
            phone = phone.removeprefix(prefix)
        return phone

    df = spark.createDataFrame([(p,) for p in phones], "phone string")
    got = {r[0]: r[1] for r in df.select("phone", cleanse_phone(F.col("phone"))).collect()}
    assert got == {p: expected(p) for p in phones}


@pytest.mark.parametrize(
    ("number", "unit", "tier", "expected"),
    [
        ("2x", "HL", "Tracking", "Beauty+"),
        ("3x", "COS", "Tracking", "Beauty+"),
        ("3x", "HL", "Tracking", "Privilege"),
        ("3x", None, "Tracking", "Privilege"),
        ("9x", "COS", "Tracking", "Privilege"),
        ("", "COS", "Tracking", "Privilege"),
        (None, "COS", "Tracking", "Privilege"),
        ("2x", "COS", "Gold", "Gold"),
        ("2x", "COS", None, None),
    ],
)
def test_update_tier(spark, number, unit, tier, expected):
    df = spark.createDataFrame([(number, unit, tier)], "n string, u string, t string")
    assert df.select(update_tier(F.col("n"), F.col("u"), F.col("t"))).first()[0] == expected


def test_tier_whitelist_and_rank(spark):
    df = spark.createDataFrame([("JB1",), ("ICARD Gold",), ("STAFF",), (None,)], "t string")
    got = df.select(
        tier_whitelist(F.col("t")), tier_whitelist(F.col("t"), FASHION_TIERS)
    ).collect()
    assert [tuple(r) for r in got] == [
        ("JB1", "OTHERS"),
        ("ICARD Gold", "ICARD Gold"),
        ("OTHERS", "OTHERS"),
        ("OTHERS", "OTHERS"),
    ]
    ranks = [r[0] for r in df.select(display_rank(F.col("t"), ["ICARD Gold", "JB1"])).collect()]
    assert ranks == [2, 1, None, None]


def test_dates(spark):
    df = spark.createDataFrame([("19980401",), ("1998-04",), (None,)], "d string")
    got = [r[0] for r in df.select(order_date_format(F.col("d"))).collect()]
    assert got == [dt.date(1998, 4, 1), None, None]
    df = spark.createDataFrame([("3999-12-31",), ("2001-01-01",), (None,)], "d string")
    got = [r[0] for r in df.select(card_date_sentinel(F.col("d"))).collect()]
    assert got == ["1999-12-31", "2001-01-01", None]


def test_tenure_years_rounds_down_and_can_be_negative(spark):
    dates = ["2000-01-01", "2000-12-30", "2000-12-31", "2002-01-01", "1990-01-01", None]
    df = spark.createDataFrame([(d,) for d in dates], "d string")
    years = tenure_years(F.col("d").cast("date"), "2001-12-31")
    assert [r[0] for r in df.select(years).collect()] == [2, 1, 1, -1, 12, None]


def test_tenure_group_edges(spark):
    years = [-1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    y = F.col("y")
    got = df.select(tenure_group(y), tenure_group(y, 0), tenure_group(y, 0, True)).collect()
    longest = "tenure>8"
    middle = ["tenure3-4"] * 2 + ["tenure5-6"] * 2 + ["tenure7-8"] * 2
    assert [r[0] for r in got] == [longest] * 2 + ["tenure1-2"] * 2 + middle + [longest] * 2
    assert [r[1] for r in got] == [longest] + ["tenure0-2"] * 3 + middle + [longest] * 2
    assert [r[2] for r in got] == (
        ["unknown"] + ["tenure0-2"] * 3 + middle + [longest, "unknown"]
    )
    assert {r[2] for r in got} == set(tenure_labels(0, strict=True))


def test_text(spark):
    df = spark.createDataFrame([(" a ", " b", 1), (None, "c ", 2)], "x string, y string, n int")
    trimmed = trim_all(df)
    assert trimmed.schema == df.schema
    assert [tuple(r) for r in trimmed.collect()] == [("a", "b", 1), (None, "c", 2)]
    assert [tuple(r) for r in trim_all(df, ["x"]).collect()] == [("a", " b", 1), (None, "c ", 2)]
    assert [tuple(r) for r in trim_all(df, stringify=True).collect()] == [
        ("a", "b", "1"),
        (None, "c", "2"),
    ]
    keys = df.select(transaction_key(F.col("x"), F.col("y")), labelled(F.col("y"), F.col("y")))
    assert [tuple(r) for r in keys.collect()] == [(" a - b", " b- b"), (None, "c -c ")]
    email = spark.createDataFrame([("Ab@X.com",), (None,)], "e string")
    assert [r[0] for r in email.select(normalise_email(F.col("e"))).collect()] == ["ab@x.com", None]


def test_category_default(spark):
    df = spark.createDataFrame(
        [("Skin", "COS"), (None, "COS"), ("Skin", "HL"), (None, None)], "m string, u string"
    )
    m, u = F.col("m"), F.col("u")
    got = df.select(category_default(m), category_default(m, u)).collect()
    assert [tuple(r) for r in got] == [
        ("Skin", "Skin"),
        ("others", "others"),
        ("Skin", "HL"),
        ("others", None),
    ]
