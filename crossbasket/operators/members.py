"""Members: type join, golden record, activity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbasket.functions.contact import cleanse_phone, normalise_email
from crossbasket.functions.dates import card_date_sentinel
from crossbasket.functions.text import trim_all
from crossbasket.functions.tiers import BEAUTY_TIERS, display_rank, tier_whitelist, update_tier
from crossbasket.operators.skew import growing, spread_join


def member_type_join(
    members: DataFrame, types: DataFrame, region: str, kept: Sequence[str] = BEAUTY_TIERS
) -> DataFrame:
    """Members with the cleaned description of their type in ``region``.

    A type code means different things in different regions. Members whose type the region
    does not know drop out.
    """
    here = (
        types.filter(F.col("region_key") == region)
        .select(F.col("viptyp_code").alias("vip_type"), "viptyp_desc")
    )
    return (
        members.join(here, ["vip_type"])
        .withColumn("viptyp_desc_cleaned", tier_whitelist(F.col("viptyp_desc"), kept))
        .drop("vip_type", "viptyp_desc")
        .distinct()
    )


def fetch_attribute(
    members: DataFrame, source: DataFrame, key: str, column: str, hot: DataFrame | None = None
) -> DataFrame:
    """The distinct rows of ``members`` with ``column`` as the rows of ``source`` with the same ``key`` have it,
    and ``copies``: how often a plain left join would give the row.

    A member with several rows on either side fans out there, rows times rows. Both sides are counted before
    they meet, so repeated rows, however many, are a number. A member without a row in ``source``, or with a
    NULL key, keeps a NULL. ``hot`` are the large keys of ``members``, if known.
    """
    rest = [name for name in members.columns if name != column]
    rows = members.groupBy(*rest).agg(F.count(F.lit(1)).alias("_rows"))
    values = source.groupBy(key, column).agg(F.count(F.lit(1)).alias("_values"))
    others = [name for name in rest if name != key]
    joined = spread_join(rows, values, [key], "left", hot, others)
    copies = F.col("_rows") * F.coalesce(F.col("_values"), F.lit(1))
    return joined.groupBy(*members.columns).agg(F.sum(copies).alias("copies"))


def repeated(rows: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as its column ``copies`` says, without that column."""
    again = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
    return again.drop("_copy", copies)


def golden_record(members: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row per key; ``rules`` gives the aggregate for each output column.

    Columns are chosen independently of each other, so the row is a composite of the
    member's records.
    """
    return members.groupBy(key).agg(*[rule.alias(name) for name, rule in rules.items()])


def first_tier(tier: Column, order: Sequence[str] | None = None) -> Column:
    """The tier that wins: the smallest text or, given ``order``, the first in it."""
    if order is None:
        return F.min(tier)
    return F.min_by(tier, F.coalesce(display_rank(tier, order), F.lit(len(order) + 1)))


def golden_record_a(members: DataFrame) -> DataFrame:
    """Chain A members, one row per ``vip_no``.

    The largest value of each column is taken, then the contacts are cleaned.
    """
    rows = trim_all(members)
    tier = update_tier(F.col("vip_no"), F.col("join_bu_desc"), F.col("card_type"))
    return golden_record(
        rows,
        "vip_no",
        {
            "mobile": cleanse_phone(F.max("phone_no")),
            "email": normalise_email(F.max("email")),
            "sex": F.max("sex"),
            "birth_date": F.max("birth_date"),
            "card_start_date": F.max(card_date_sentinel(F.col("card_start_date"))),
            "join_bu_desc": F.max("join_bu_desc"),
            "first_purchase": F.max("first_transaction_date").try_cast("date"),
            "tier": F.max(tier),
            "nationality": F.max("country_of_residence"),
        },
    )


def golden_record_b(
    members: DataFrame,
    types: DataFrame,
    region: str,
    kept: Sequence[str] = BEAUTY_TIERS,
    tier_order: Sequence[str] | None = None,
) -> DataFrame:
    """Chain B members with a type in ``region``, one row per ``vip_main_no``.

    The largest value of each column is taken, then the contacts are cleaned; of several
    tiers the smallest text wins unless ``tier_order`` ranks them.
    """
    return golden_record(
        member_type_join(trim_all(members), types, region, kept),
        "vip_main_no",
        {
            "mobile": cleanse_phone(F.max("vip_tel_2")),
            "email": normalise_email(F.max("vip_email")),
            "birth_year": F.max("vip_birth_iyy"),
            "birth_month": F.max("vip_birth_imm"),
            "birth_day": F.max("vip_birth_idd"),
            "sex": F.max("vip_sex"),
            "first_purchase": F.max("vip_first_pur_date").try_cast("date"),
            "issue_date": F.max("vip_issue_date").try_cast("date"),
            "tier": first_tier(F.col("viptyp_desc_cleaned"), tier_order),
            "nationality": F.max("region_key"),
        },
    )


def active_members(members: DataFrame, sales: DataFrame, key: str) -> DataFrame:
    """Distinct members with at least one line in ``sales``.

    The lines shrink to distinct keys on the map side first, so a key with very many lines
    costs no more than any other.
    """
    buyers = sales.select(key).distinct()
    return members.join(growing(buyers), [key], "left_semi").distinct()
