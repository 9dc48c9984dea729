"""Buyers of a brand followed over two years across two matched chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbasket.operators.matching import pair_counts, pairs_per_member
from crossbasket.operators.skew import growing

BOTH, ONLY_A, ONLY_B, NEITHER = "both", "a_only", "b_only", "inactive"


def _label(in_a: Column, in_b: Column) -> Column:
    label = F.when(in_a & in_b, BOTH).when(in_a, ONLY_A).when(in_b, ONLY_B)
    return label.otherwise(NEITHER)


def _flagged(members: DataFrame, key: str, buyers: DataFrame, flag: str) -> DataFrame:
    wanted = buyers.select(F.col(buyers.columns[0]).alias(key)).dropna().distinct()
    return members.join(growing(wanted.withColumn(flag, F.lit(True))), [key], "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def _alone(
    members: DataFrame, key: str, first: DataFrame, second: DataFrame, others: DataFrame
) -> DataFrame:
    """First-year buyers of one chain that a full outer join shows without a partner: those
    with a match who did not buy (``_one`` false in ``others``), or with no match at all.
    Columns: key, ``stays``."""
    buyers = first.select(F.col(first.columns[0]).alias(key)).dropna().distinct()
    known = members.filter("_one")
    pairs = pairs_per_member(known, others, key, {"n_idle": ~F.col("_one")})
    counted = buyers.join(growing(pairs), [key], "left")
    alone = counted.filter(F.col("n_pairs").isNull() | (F.col("n_idle") > 0))
    return _flagged(alone.select(key), key, second, "stays")


def cohort_retention(
    a: DataFrame,
    b: DataFrame,
    a_key: str,
    b_key: str,
    a_first: DataFrame,
    b_first: DataFrame,
    a_second: DataFrame,
    b_second: DataFrame,
) -> DataFrame:
    """First-year buyers by where they bought in year one and year two: ``label_first``,
    ``label_second``, ``n``.

    The unit is a distinct (A buyer, B buyer) combination out of the full outer joins of the
    pair list with both first-year buyer lists; ``*_first`` and ``*_second`` are the buyer
    keys of a year. Combinations of two buyers are counted as pairs by second-year flags,
    the others member by member, so the pair list is never built.
    """
    yes, no = F.lit(True), F.lit(False)
    in_a = _flagged(_flagged(a, a_key, a_first, "_one"), a_key, a_second, "a_stays")
    in_b = _flagged(_flagged(b, b_key, b_first, "_one"), b_key, b_second, "b_stays")
    together = pair_counts(
        in_a.filter("_one"), in_b.filter("_one"), ["a_stays"], ["b_stays"], "n"
    ).select(
        _label(yes, yes).alias("label_first"),
        _label(F.col("a_stays"), F.col("b_stays")).alias("label_second"),
        "n",
    )
    one = F.lit(1).cast("bigint")
    a_alone = _alone(in_a, a_key, a_first, a_second, in_b).select(
        _label(yes, no).alias("label_first"), _label(F.col("stays"), no).alias("label_second"),
        one.alias("n"),
    )
    b_alone = _alone(in_b, b_key, b_first, b_second, in_a).select(
        _label(no, yes).alias("label_first"), _label(no, F.col("stays")).alias("label_second"),
        one.alias("n"),
    )
    rows = together.unionByName(a_alone).unionByName(b_alone)
    return rows.groupBy("label_first", "label_second").agg(F.sum("n").alias("n"))


def pivot_retention(counts: DataFrame) -> DataFrame:
    """Year-one labels down, year-two labels across."""
    return counts.groupBy("label_first").pivot(
        "label_second", [BOTH, ONLY_A, ONLY_B, NEITHER]
    ).agg(F.first("n"))
