"""Marking the rows of overlapping customers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbasket.operators.skew import growing, spread_join


def overlap_flags(key: str, overlaps: Mapping[str, DataFrame]) -> DataFrame:
    """One row per key in any of ``overlaps`` (label -> keys to mark), a 0/1 column each."""
    marked = None
    for label, keys in overlaps.items():
        named = keys.select(F.col(keys.columns[0]).alias(key), F.lit(label).alias("_label"))
        marked = named if marked is None else marked.unionByName(named)
    return marked.groupBy(key).agg(
        *[F.max((F.col("_label") == label).cast("int")).alias(label) for label in overlaps]
    )


def label_rows(
    df: DataFrame,
    key: str,
    flags: DataFrame,
    dedup_rows: bool = True,
    unique_key: bool = False,
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``df`` with the columns of ``flags`` (one row per key), 0 for keys it lacks.

    Identical rows collapse to one, as sales lines without a line number can be; that comes
    first because it combines on the map side. ``unique_key`` says that ``df`` has one row
    per key, so that there are no large groups to spread (``hot``, ``by``: see ``spread_join``).
    """
    rows = df.distinct() if dedup_rows else df
    labels = [label for label in flags.columns if label != key]
    if unique_key:
        joined = rows.join(growing(flags), [key], "left")
    else:
        joined = spread_join(rows, flags, [key], "left", hot, by)
    marks = [F.coalesce(F.col(label), F.lit(0)).alias(label) for label in labels]
    return joined.select(*df.columns, *marks)


def label_overlap(
    df: DataFrame,
    key: str,
    overlaps: Mapping[str, DataFrame],
    dedup_rows: bool = True,
    unique_key: bool = False,
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``df`` with a 0/1 column per entry of ``overlaps`` (label -> keys to mark).

    All labels are gathered per key first, so that ``df`` is collapsed and joined once
    whatever their number.
    """
    return label_rows(df, key, overlap_flags(key, overlaps), dedup_rows, unique_key, hot, by)


def label_fanout(
    df: DataFrame,
    key: str,
    pairs_of_key: DataFrame,
    label: str,
    copies: str = "copies",
    how: str = "left",
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows with a 0/1 label and the number of copies a plain join to the pair list gives.

    ``pairs_of_key`` is (``key``, ``n_pairs``) from ``pairs_per_member``. A customer with k
    matches has every line k times in such a join, so amounts grow k-fold and distinct
    counts do not; weighting by ``copies`` gives those amounts without repeating lines. With
    ``how`` "inner" only the lines of matched customers are kept.
    """
    joined = spread_join(df, pairs_of_key, [key], how, hot, by)
    return joined.select(
        *df.columns,
        F.col("n_pairs").isNotNull().cast("int").alias(label),
        F.coalesce(F.col("n_pairs"), F.lit(1)).alias(copies),
    )


def segment_keys(buyers: DataFrame, matched: DataFrame, key: str, inside: bool) -> DataFrame:
    """Distinct buyers among the matched keys or, with ``inside`` false, outside them.

    Outside follows SQL ``NOT IN``; matched keys are never NULL.
    """
    wanted = buyers.select(key).dropna().distinct()
    known = matched.select(F.col(matched.columns[0]).alias(key)).distinct()
    return wanted.join(growing(known), [key], "left_semi" if inside else "left_anti")
