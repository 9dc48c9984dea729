"""Figures of overlapping customers, from labelled sales and members.

A labelled frame has 0/1 columns; the figures of chain A are taken over A's rows labelled
with the other chain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbasket.functions.dates import TENURE_GROUPS, tenure_years
from crossbasket.functions.tiers import display_rank


@dataclass(frozen=True)
class Chain:
    """A chain's labelled sales and members and the columns that play the roles.

    ``orders``, if there, are the parts of the orders (``order_parts``), and ``bits`` the labels' bits in them.
    """

    name: str
    sales: DataFrame
    members: DataFrame
    key: str
    order: str
    amount: str = "amt"
    qty: str = "qty"
    orders: DataFrame | None = None
    bits: Mapping[str, int] = field(default_factory=dict)

    def overlapping(self, label: str) -> DataFrame:
        return self.sales.filter(F.col(label) == 1)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole`` as a rounded double; NULL where ``whole`` is zero or missing."""
    quotient = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.round(quotient, digits)


def percent(part: Column, whole: Column) -> Column:
    quotient = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.round(quotient * 100, 2)


def _amount(chain: Chain) -> Column:
    return F.sum(chain.amount)


def _units(chain: Chain) -> Column:
    return F.sum(chain.qty)


def _has_bit(mask: str, bit: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << bit)) != 0


def mask_of(conditions: Sequence[Column]) -> Column:
    """Which of up to 63 conditions a row meets, as the bits of one number."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(conditions)]
    return reduce(Column.bitwiseOR, bits)


def order_parts(
    sales: DataFrame, order: str, conditions: Sequence[Column], amount: str = "amt", qty: str = "qty"
) -> DataFrame:
    """Sales lines by order and mask of the conditions they meet: ``order``, ``mask``, ``amt``, ``qty`` and
    ``counted``: the bits in which this part stands for the order.

    An order has one part, or a few if its lines differ. Each condition that any of its lines meets is counted in
    exactly one of its parts, so the number of orders is a plain sum. Lines without an order are
    in the amounts only.
    """
    masks = sales.groupBy(F.col(order).alias("order"), mask_of(conditions).alias("mask")).agg(
        F.sum(amount).alias("amt"), F.sum(qty).alias("qty")
    )
    # at most one row for each combination of conditions
    parts = masks.groupBy("order").agg(F.collect_list(F.struct("mask", "amt", "qty")).alias("parts"))
    part = parts.select("order", F.posexplode("parts").alias("at", "part"), F.col("parts.mask").alias("masks"))
    before = F.reduce(
        F.slice("masks", F.lit(1), F.col("at")), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)
    )
    mask = F.col("part.mask")
    counted = F.when(F.col("order").isNotNull(), mask.bitwiseAND(F.bitwise_not(before))).otherwise(F.lit(0))
    return part.select("order", "part.mask", "part.amt", "part.qty", counted.cast("bigint").alias("counted"))


def order_totals(parts: DataFrame, cases: Mapping[str, int]) -> DataFrame:
    """``name``, ``amt``, ``qty`` and ``orders`` of each case, a bit in the masks of ``parts``; one scan, plain sums."""
    sums = []
    for i, bit in enumerate(cases.values()):
        met = _has_bit("mask", bit)
        sums += [F.sum(F.when(met, F.col(name))).alias(f"{name}_{i}") for name in ("amt", "qty")]
        sums.append(F.coalesce(F.sum(F.when(_has_bit("counted", bit), 1)), F.lit(0)).alias(f"orders_{i}"))
    entries = [
        F.struct(F.lit(name).alias("name"), *[F.col(f"{k}_{i}").alias(k) for k in ("amt", "qty", "orders")])
        for i, name in enumerate(cases)
    ]
    return parts.agg(*sums).select(F.inline(F.array(*entries)))


def totals(chain: Chain, label: str) -> DataFrame:
    """``amt``, ``qty`` and ``orders`` of the overlapping customers, in one row."""
    if chain.orders is not None:
        return order_totals(chain.orders, {label: chain.bits[label]}).drop("name")
    return chain.overlapping(label).agg(
        _amount(chain).alias("amt"), _units(chain).alias("qty"), F.countDistinct(chain.order).alias("orders")
    )


def aov(chain: Chain, label: str) -> DataFrame:
    """Average order value."""
    return totals(chain, label).select(ratio(F.col("amt"), F.col("orders")).alias("aov"))


def upt(chain: Chain, label: str) -> DataFrame:
    """Units per transaction."""
    return totals(chain, label).select(ratio(F.col("qty"), F.col("orders")).alias("upt"))


def avg_price_point(chain: Chain, label: str) -> DataFrame:
    """Amount per unit."""
    return totals(chain, label).select(ratio(F.col("amt"), F.col("qty")).alias("avg_price_point"))


def avg_trans_per_cust(chain: Chain, label: str, n_customers: DataFrame) -> DataFrame:
    """Transactions per unique overlapping customer; ``n_customers`` is a single value."""
    per_customer = ratio(F.col("orders"), n_customers.scalar())
    return totals(chain, label).select(per_customer.alias("avg_trans_per_cust"))


def avg_spend_per_cust(chain: Chain, label: str, n_customers: DataFrame) -> DataFrame:
    """Amount per unique overlapping customer; ``n_customers`` is a single value."""
    per_customer = ratio(F.col("amt"), n_customers.scalar())
    return totals(chain, label).select(per_customer.alias("avg_spend_per_cust"))


# The figures of ``sales_behavior``, in display order.
BEHAVIOR_METRICS = [
    "n_customers", "aov", "upt", "avg_trans_per_cust", "avg_spend_per_cust", "avg_price_point",
]


def behavior_metrics(totals: DataFrame) -> DataFrame:
    """The six sales figures of rows (``pair``, ``side``, ``amt``, ``qty``, ``orders``, ``n``), in long form."""
    amt, qty, orders, n = (F.col(c) for c in ("amt", "qty", "orders", "n"))
    return totals.select(
        "pair",
        "side",
        n.cast("double").alias("n_customers"),
        ratio(amt, orders).alias("aov"),
        ratio(qty, orders).alias("upt"),
        ratio(orders, n).alias("avg_trans_per_cust"),
        ratio(amt, n).alias("avg_spend_per_cust"),
        ratio(amt, qty).alias("avg_price_point"),
    ).unpivot(["pair", "side"], None, "metric", "value")


def _behavior(chain: Chain, label: str, n_customers: DataFrame, pair: str) -> DataFrame:
    sums = totals(chain, label).withColumn("n", n_customers.scalar())
    return behavior_metrics(
        sums.withColumns({"pair": F.lit(pair), "side": F.lit(chain.name)})
    )


def sales_behavior(
    a: Chain, b: Chain, a_label: str, b_label: str, n_customers: DataFrame
) -> DataFrame:
    """Six sales figures of either chain's overlapping customers, one row per figure.

    ``a_label`` marks A's customers in B's sales and vice versa. Each side is one pass.
    """
    pair = f"{a.name}_{b.name}"
    left = _behavior(a, b_label, n_customers, pair)
    return left.unionByName(_behavior(b, a_label, n_customers, pair))


def count_keys_if(df: DataFrame, key: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Distinct keys with any row meeting each condition, in one row; a NULL key counts.

    Conditions are first combined per key, on the map side as well, so there is one shuffle
    of one row per key whatever the number of conditions.
    """
    per_key = df.groupBy(key).agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]
    )
    return per_key.agg(
        *[F.count(F.when(F.col(name), 1)).alias(name) for name in conditions]
    )


def count_keys_by_mask(df: DataFrame, key: str, conditions: Mapping[str, Column]) -> DataFrame:
    """As ``count_keys_if`` for up to 63 conditions, as rows ``name``, ``n``.

    A key's rows are combined into one number, and keys are counted by it before conditions are told apart.
    """
    per_key = df.groupBy(key).agg(F.bit_or(mask_of(list(conditions.values()))).alias("mask"))
    masks = per_key.groupBy("mask").agg(F.count(F.lit(1)).alias("keys"))
    counts = [
        F.coalesce(F.sum(F.when(_has_bit("mask", i), F.col("keys"))), F.lit(0)).alias(f"n_{i}") for i in range(len(conditions))
    ]
    entries = [F.struct(F.lit(name).alias("name"), F.col(f"n_{i}").alias("n")) for i, name in enumerate(conditions)]
    return masks.agg(*counts).select(F.inline(F.array(*entries)))


def sums_by_mask(
    df: DataFrame, dim: str, conditions: Mapping[str, Column], amount: str = "amt", qty: str = "qty"
) -> DataFrame:
    """``name``, ``dim``, ``amt``, ``qty`` over the rows that meet each condition, of which each row may meet several:
    rows are grouped once by ``dim`` and mask, and the masks rolled up."""
    masks = df.groupBy(dim, mask_of(list(conditions.values())).alias("mask")).agg(
        F.sum(amount).alias("amt"), F.sum(qty).alias("qty")
    )
    names = F.array(*[F.when(_has_bit("mask", i), F.lit(name)) for i, name in enumerate(conditions)])
    met = masks.withColumn("name", F.explode(F.array_compact(names)))
    return met.groupBy("name", dim).agg(F.sum("amt").alias("amt"), F.sum("qty").alias("qty"))


def overlap_penetration(chain: Chain, label: str) -> DataFrame:
    """Overlapping customers as a share of all customers in the sales."""
    counts = count_keys_if(
        chain.sales, chain.key, {"n_overlap": F.col(label) == 1, "n_all": F.lit(True)}
    )
    share = ratio(F.col("n_overlap"), F.col("n_all"), 6)
    return counts.withColumn("penetration", share)


def tenure_conditions(as_of, since: str = "first_purchase") -> dict[str, Column]:
    """The tenure groups of ``tenure_share``, in their order."""
    years = tenure_years(F.col(since), as_of)
    groups = {"tenure1-2": years <= 2}
    groups |= {name: years.between(low, high) for name, low, high in TENURE_GROUPS}
    return groups | {"tenure>8": years > 8}


def tenure_share(chain: Chain, label: str, as_of, since: str = "first_purchase") -> DataFrame:
    """Overlapping members by tenure group, as shares of all of them.

    Unlike ``tenure_group`` the first group takes zero and negative tenures too, and members
    without a date are in the whole only.
    """
    groups = tenure_conditions(as_of, since)
    overlapping = chain.members.filter(F.col(label) == 1)
    counts = count_keys_if(overlapping, chain.key, {**groups, "_all": F.lit(True)})
    shares = [percent(F.col(f"`{name}`"), F.col("_all")).alias(name) for name in groups]
    return counts.select(*shares).unpivot([], None, "tenure", "pct")


def demo_table(a: Chain, b: Chain, a_label: str, b_label: str, as_of) -> DataFrame:
    """Penetration and tenure shares of either chain's overlapping customers, in percent."""

    def side(chain: Chain, label: str) -> DataFrame:
        share = percent(F.col("n_overlap"), F.col("n_all")).alias("pct")
        whole = overlap_penetration(chain, label)
        top = whole.select(F.lit("overlap_customers").alias("metric"), share)
        tenures = tenure_share(chain, label, as_of).withColumnRenamed("tenure", "metric")
        return top.unionByName(tenures).select(F.lit(chain.name).alias("side"), "metric", "pct")

    return side(a, b_label).unionByName(side(b, a_label))


def share_of_wallet(a: Chain, b: Chain, a_label: str, b_label: str) -> DataFrame:
    """Sales to overlapping customers per chain and its percentage of both together."""

    def side(chain: Chain, label: str) -> DataFrame:
        return totals(chain, label).select(F.lit(chain.name).alias("side"), "amt")

    sides = side(a, b_label).unionByName(side(b, a_label))
    # missing sales on one side leave both shares missing, as a sum with NULL does
    both = sides.agg(
        F.when(F.count("amt") == 2, F.sum("amt")).alias("both")
    )
    return sides.select(
        "side",
        F.round(F.col("amt").cast("double"), 4).alias("sales"),
        percent(F.col("amt"), both.scalar()).alias("share_pct"),
    )


def tier_percent(
    chain: Chain, label: str, order: Sequence[str], tier: str = "tier"
) -> DataFrame:
    """Overlapping members per tier, in display order, unlisted tiers last."""
    rows = chain.members.filter(F.col(label) == 1).select(tier, chain.key).distinct()
    per_tier = rows.groupBy(tier).agg(F.count(chain.key).alias("n_members"))
    total = rows.agg(F.countDistinct(chain.key).alias("n")).scalar()
    return per_tier.select(
        F.col(tier).alias("tier"),
        "n_members",
        ratio(F.col("n_members"), total, 6).alias("share"),
        display_rank(F.col(tier), order).alias("display_order"),
    ).orderBy(F.asc_nulls_last("display_order"), F.asc_nulls_last("tier"))


def pricepoint_by_cat(
    sales: DataFrame, category: str = "arti_cate_name", amount: str = "amt", qty: str = "qty"
) -> DataFrame:
    """Amount, units and amount per unit of each category."""
    sums = sales.groupBy(category).agg(F.sum(amount).alias("amt"), F.sum(qty).alias("qty"))
    return sums.select(
        F.col(category).alias("category"),
        F.round(F.col("amt").cast("double"), 4).alias("sum_sales"),
        F.col("qty").cast("double").alias("sum_qty"),
        ratio(F.col("amt"), F.col("qty")).alias("price_point"),
    )


def pricepoint_table(
    a: Chain, b: Chain, a_label: str, b_label: str, category: str = "arti_cate_name"
) -> DataFrame:
    """Price points of both chains' overlapping customers side by side; NULL where unsold."""

    def side(chain: Chain, label: str) -> DataFrame:
        sums = chain.overlapping(label).groupBy(F.col(category).alias("category")).agg(
            _amount(chain).alias("_amt"), _units(chain).alias("_qty")
        )
        price = ratio(F.col("_amt"), F.col("_qty"), 2)
        return sums.select("category", price.alias(f"{chain.name}_price_point"))

    return side(a, b_label).join(side(b, a_label), ["category"], "full")
