"""Stores and customer lists: who joined or shops where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbasket.operators.kpi import count_keys_if
from crossbasket.operators.skew import growing


def store_lookup(sales: DataFrame, stores: DataFrame, store: str) -> DataFrame:
    """Distinct store codes with their name, where known."""
    codes = sales.select(store).distinct()
    names = stores.select(F.col("store_id").alias(store), "store_name")
    return codes.join(names, [store], "left").distinct()


def with_store(sales: DataFrame, stores: DataFrame, store: str, name: str) -> DataFrame:
    """Lines with the store's ``name`` column, where known."""
    names = stores.select(F.col("store_id").alias(store), name)
    return sales.join(names, [store], "left")


def store_in_out(sales: DataFrame, key: str, store: str, shops: Sequence[str]) -> DataFrame:
    """Customers of ``shops``, and those of them who also shop elsewhere: one row.

    A line without a store is on neither side; a line without a customer is not counted.
    """
    inside = F.col(store).isin(*shops)
    per_key = sales.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.coalesce(inside, F.lit(False))).alias("i"),
        F.max(F.coalesce(~inside, F.lit(False))).alias("o"),
    )
    return per_key.agg(
        F.count(F.when(F.col("i"), 1)).alias("n_inside"),
        F.count(F.when(F.col("i") & F.col("o"), 1)).alias("n_both"),
    )


def shared_customers(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Customers found in both frames (``INTERSECT`` of the distinct keys)."""
    return one.select(key).distinct().intersect(other.select(key).distinct())


def issue_right_join(
    issue: DataFrame,
    sales: DataFrame,
    member: str,
    location: str,
    key: str,
    shops: Sequence[str],
    in_window: Column,
) -> DataFrame:
    """Listed members who joined at ``shops`` and bought, counted over a right join to the
    list: conditions in the join or after it, with and without the sales window.

    A condition in the join keeps list rows without sales, one after it drops them; only
    members with sales are counted, so both ways agree.
    """
    buyers = sales.groupBy(F.col(key).alias("_key")).agg(
        F.max(F.coalesce(in_window, F.lit(False))).alias("_window")
    )
    listed = issue.select(F.col(member).alias("_key"), F.col(location).alias("_loc")).distinct()
    at_shops = F.col("_loc").isin(*shops)
    rows = listed.join(growing(buyers), ["_key"], "left").withColumn("_sold", F.col("_window").isNotNull())
    return count_keys_if(
        rows.filter(F.col("_key").isNotNull()),
        "_key",
        {
            "n_listed": F.lit(True),
            "n_sold": F.col("_sold"),
            "n_sold_at_shops": F.col("_sold") & at_shops,
            "n_sold_at_shops_in_window": F.col("_window") & at_shops,
        },
    )


def issue_counts(
    issue: DataFrame,
    sales: DataFrame,
    member: str,
    location: str,
    key: str,
    store: str,
    shops: Sequence[str],
    labels: Sequence[str],
) -> DataFrame:
    """Listed buyers by where they joined (``joined_in`` / ``_out`` of ``shops``) and where
    they shop, the two intersections, and the joiners elsewhere with a line where all of
    ``labels`` are 0.

    A joining place and a shopping place are independent given the member, so each side is
    reduced to one row of flags per member before they meet.
    """

    def any_row(condition: Column) -> Column:
        return F.max(F.coalesce(condition, F.lit(False)))

    at_location = F.col(location).isin(*shops)
    joined = issue.filter(F.col(member).isNotNull()).groupBy(F.col(member).alias("_key")).agg(
        any_row(at_location).alias("j_in"), any_row(~at_location).alias("j_out")
    )
    at_store = F.col(store).isin(*shops)
    unlabelled = F.lit(True)
    for label in labels:
        unlabelled = unlabelled & (F.col(label) == 0)
    shopped = sales.groupBy(F.col(key).alias("_key")).agg(
        any_row(at_store).alias("s_in"),
        any_row(~at_store).alias("s_out"),
        any_row(unlabelled).alias("plain"),
    )
    j_in, j_out, s_in, s_out = (F.col(c) for c in ("j_in", "j_out", "s_in", "s_out"))
    cases = {
        "n_buyers": F.lit(True),
        "joined_out": j_out,
        "joined_out_shop_out": j_out & s_out,
        "joined_out_shop_in": j_out & s_in,
        "joined_out_shop_both": j_out & s_out & s_in,
        "joined_in_shop_in": j_in & s_in,
        "joined_in_shop_out": j_in & s_out,
        "joined_in_shop_both": j_in & s_in & s_out,
        "joined_out_unlabelled": j_out & F.col("plain"),
    }
    both = joined.join(growing(shopped), ["_key"])
    counts = both.agg(*[F.count(F.when(c, 1)).alias(name) for name, c in cases.items()])
    return counts.unpivot([], None, "case", "n_members")
