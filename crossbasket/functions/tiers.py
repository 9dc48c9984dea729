"""Membership tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier descriptions kept as they are, per market segment.
BEAUTY_TIERS = (
    "JB1",
    "JB ESTEEME",
    "JB ESSENTIAL",
    "ICARD Pre-member",
    "ICARD Silver",
    "ICARD Gold",
    "ICARD Diamond",
    "ICARD Diamond - Taiwan",
)
FASHION_TIERS = (
    "ICARD Pre-member",
    "ICARD Silver",
    "ICARD Gold",
    "ICARD Diamond",
    "ICARD Diamond - Taiwan",
)
OTHER_TIER = "OTHERS"

# The order in which reports list the tiers.
TIER_ORDER_A = ("Beauty+", "Privilege", "Gold", "Platinum", "Diamond")
TIER_ORDER_B = ("ICARD Silver", "ICARD Gold", "ICARD Diamond", "ICARD Pre-member", "OTHERS")
TIER_ORDER_C = ("JB ESSENTIAL", "JB ESTEEME", "JB1", "OTHERS")


def update_tier(member_no: Column, join_unit: Column, tier: Column) -> Column:
    """Resolve the provisional tier; every other tier, NULL included, stays as it is."""
    first = F.substring(member_no, 1, 1)
    beauty = first.eqNullSafe("2") | (first.eqNullSafe("3") & join_unit.eqNullSafe("COS"))
    resolved = F.when(beauty, "Beauty+").otherwise("Privilege")
    return F.when(tier == "Tracking", resolved).otherwise(tier)


def tier_whitelist(tier: Column, kept: Sequence[str] = BEAUTY_TIERS) -> Column:
    return F.when(tier.isin(*kept), tier).otherwise(OTHER_TIER)


def display_rank(tier: Column, order: Sequence[str]) -> Column:
    """Position in ``order`` from 1; NULL for a tier the order does not list."""
    ranks = F.create_map(*[F.lit(x) for pair in zip(order, range(1, len(order) + 1)) for x in pair])
    return F.try_element_at(ranks, tier)
