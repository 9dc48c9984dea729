"""Customers of two chains matched by e-mail or mobile number.

Two members match if their e-mails are equal or their mobiles are, blank and missing
contacts never. The matched pairs multiply where many members share a contact: a phone
entered as a placeholder by a tenth of each chain alone gives a hundredth of the full cross
product. So only ``match_customers``, whose result *is* the pair list, builds pairs.
Everything else - who overlaps, how many unique customers, pairs per member, pairs per
attribute combination - is computed from the members grouped by contact, in space linear in
the members, and equals what the pair list would give.

Member frames have one row per ``key`` and the columns ``email`` and ``mobile``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbasket.functions.contact import usable
from crossbasket.operators.skew import growing, pair_join, spread_join

_CONTACT = ["_channel", "_value"]
_LINK = ["_channel", "_value", "_value2"]


def _contacts(members: DataFrame, *kept: str) -> DataFrame:
    """One row per member and usable contact."""
    both = F.explode(
        F.array(
            F.struct(F.lit("email").alias("_channel"), F.col("email").alias("_value")),
            F.struct(F.lit("mobile").alias("_channel"), F.col("mobile").alias("_value")),
        )
    )
    rows = members.select(*kept, both.alias("_contact")).select(*kept, "_contact.*")
    return rows.filter(usable(F.col("_value")))


def _columns_but_contacts(members: DataFrame) -> list[str]:
    return [name for name in members.columns if name not in ("email", "mobile")]


def _links(members: DataFrame, *kept: str) -> DataFrame:
    """``_contacts`` plus one row per member with both contacts usable, of sign -1.

    A pair that agrees on both contacts is met once by e-mail, once by mobile and once,
    negatively, by the combination: in a signed sum every pair counts once.
    """
    email, mobile = F.col("email"), F.col("mobile")
    none = F.lit("")

    def link(channel: str, value, value2, sign: int):
        return F.struct(
            F.lit(channel).alias("_channel"),
            value.alias("_value"),
            value2.alias("_value2"),
            F.lit(sign).alias("_sign"),
        )

    three = F.array(
        F.when(usable(email), link("email", email, none, 1)),
        F.when(usable(mobile), link("mobile", mobile, none, 1)),
        F.when(usable(email) & usable(mobile), link("both", email, mobile, -1)),
    )
    exploded = members.select(*kept, F.explode(F.array_compact(three)).alias("_link"))
    return exploded.select(*kept, "_link.*")


def match_customers(
    a: DataFrame,
    b: DataFrame,
    a_key: str,
    b_key: str,
    a_name: str,
    b_name: str,
    with_contacts: bool = True,
) -> DataFrame:
    """All distinct matched pairs, from one equi-join on channel and contact.

    A contact's pairs are dealt by their number, n_a times n_b, so one that is shared by very many
    members on both sides fills all tasks. A pair that agrees on both contacts meets by e-mail and by
    mobile and is left out by mobile, so the pairs need no de-duplication of their own.
    """

    def side(members: DataFrame, key: str, tag: str) -> DataFrame:
        columns = members.select(F.col(key), F.col("email"), F.col("mobile")).distinct()
        return columns.toDF(f"{tag}_key", f"{tag}_email", f"{tag}_mobile")

    def by_contact(members: DataFrame, tag: str) -> DataFrame:
        both = F.array(
            F.struct(F.lit("email").alias("_channel"), F.col(f"{tag}_email").alias("_value")),
            F.struct(F.lit("mobile").alias("_channel"), F.col(f"{tag}_mobile").alias("_value")),
        )
        return members.select("*", F.inline(both)).filter(usable(F.col("_value")))

    left, right = by_contact(side(a, a_key, "_a"), "_a"), by_contact(side(b, b_key, "_b"), "_b")
    same_email = F.coalesce(
        usable(F.col("_a_email")) & (F.col("_a_email") == F.col("_b_email")), F.lit(False)
    )
    met = pair_join(left, right, ["_value", "_channel"], ["_a_key"], ["_b_key"])
    pairs = met.filter((F.col("_channel") == "email") | ~same_email)
    out = [
        F.col("_a_key").alias(f"{a_name}_key"),
        F.col("_b_key").alias(f"{b_name}_key"),
        F.lit(f"{a_name}_{b_name}").alias("overlap_name"),
    ]
    if with_contacts:
        out += [
            F.col("_a_email").alias(f"{a_name}_email"),
            F.col("_b_email").alias(f"{b_name}_email"),
            F.col("_a_mobile").alias(f"{a_name}_mobile"),
            F.col("_b_mobile").alias(f"{b_name}_mobile"),
        ]
    return pairs.select(*out)


def smallest_partners(
    members: DataFrame, key: str, others: Mapping[str, tuple[DataFrame, str]]
) -> DataFrame:
    """For each member the smallest key matched in each of several chains.

    ``others`` names the chains as label -> (members, key column); the result has ``key``
    and a column per label, NULL where the member has no match, and only members with any.
    The chains' members are first reduced to one row per contact, so the join meets each
    contact once however many members share it and whatever the number of chains.
    """
    tagged = None
    for label, (frame, other_key) in others.items():
        rows = _contacts(frame.select(F.col(other_key).alias("_other"), "email", "mobile"), "_other")
        rows = rows.withColumn("_label", F.lit(label))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    groups = tagged.groupBy(*_CONTACT).agg(
        *[F.min(F.when(F.col("_label") == label, F.col("_other"))).alias(label) for label in others]
    )
    joined = spread_join(_contacts(members, key), groups, _CONTACT, by=[key])
    return joined.groupBy(key).agg(*[F.min(label).alias(label) for label in others])


def overlap_keys(members: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the members who match anybody among ``others``."""
    known = _contacts(others).distinct()
    return spread_join(_contacts(members, key), known, _CONTACT, "left_semi", by=[key]).select(key).distinct()


def count_unique_customers(pairs: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Unique customers of a pair list, one row ``n``.

    Every B key goes to its smallest A key and the distinct of those are counted, so the
    number depends on which chain comes first.
    """
    smallest = pairs.groupBy(b_key).agg(F.min(a_key).alias("_a"))
    return smallest.agg(F.countDistinct("_a").alias("n"))


def unique_customers(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """``count_unique_customers`` of the pairs of ``a`` and ``b``, without the pairs."""
    partners = smallest_partners(b, b_key, {"_partner": (a, a_key)})
    return partners.agg(F.countDistinct("_partner").alias("n"))


def pairs_per_member(
    members: DataFrame,
    others: DataFrame,
    key: str,
    among: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The number of distinct pairs each matched member is part of: ``key``, ``n_pairs``.

    ``among`` adds columns that count only the pairs whose other member meets a condition.
    """
    conditions = {"n_pairs": F.lit(True), **(among or {})}
    groups = _links(others, *_columns_but_contacts(others)).groupBy(*_LINK).agg(
        *[F.count(F.when(c, 1)).alias(name) for name, c in conditions.items()]
    )
    joined = spread_join(_links(members, key), groups, _LINK, by=[key])
    return joined.groupBy(key).agg(
        *[F.sum(F.col("_sign") * F.col(name)).alias(name) for name in conditions]
    )


def pair_counts(
    a: DataFrame,
    b: DataFrame,
    a_attrs: Sequence[str] = (),
    b_attrs: Sequence[str] = (),
    name: str = "n_pairs",
) -> DataFrame:
    """Pairs counted by attributes of their two members.

    Per contact, members are counted by attribute first; a contact then holds no more rows
    than there are attribute values, however many members share it, and the products of the
    two counts add up to the pairs. The attributes of the two sides need different names.
    """
    left = _links(a, *a_attrs).groupBy(*_LINK, "_sign", *a_attrs)
    right = _links(b, *b_attrs).groupBy(*_LINK, *b_attrs)
    joined = left.agg(F.count(F.lit(1)).alias("_na")).join(
        growing(right.agg(F.count(F.lit(1)).alias("_nb"))), _LINK
    )
    counted = joined.groupBy(*a_attrs, *b_attrs).agg(
        F.coalesce(F.sum(F.col("_sign") * F.col("_na") * F.col("_nb")), F.lit(0)).alias(name)
    )
    return counted.filter(F.col(name) > 0) if a_attrs or b_attrs else counted
