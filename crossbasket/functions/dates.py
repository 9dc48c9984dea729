"""Dates and tenure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The open-ended card date and what stands for it.
OPEN_CARD_DATE = "3999-12-31"
CARD_DATE_STAND_IN = "1999-12-31"

# Tenure groups after the first as (label, from, to) in full years.
TENURE_GROUPS = (("tenure3-4", 3, 4), ("tenure5-6", 5, 6), ("tenure7-8", 7, 8))
LONGEST_TENURE = "tenure>8"


def order_date_format(compact: Column) -> Column:
    """``yyyyMMdd`` text as a date; text that is no date gives NULL instead of an error."""
    return F.try_to_date(compact, "yyyyMMdd")


def card_date_sentinel(date: Column) -> Column:
    return F.when(date == OPEN_CARD_DATE, CARD_DATE_STAND_IN).otherwise(date)


def _as_date(as_of: Column | dt.date | str) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def tenure_years(since: Column, as_of: Column | dt.date | str) -> Column:
    """Full years of 365 days from ``since`` to ``as_of``; negative for a later date."""
    return F.floor(F.datediff(_as_date(as_of), since) / 365)


def tenure_labels(low: int = 1, strict: bool = False) -> list[str]:
    """All labels ``tenure_group`` can give."""
    labels = [f"tenure{low}-2", *(label for label, _, _ in TENURE_GROUPS), LONGEST_TENURE]
    return [*labels, "unknown"] if strict else labels


def tenure_group(years: Column, low: int = 1, strict: bool = False) -> Column:
    """Tenure label; the first group starts at ``low``.

    Whatever no group covers - zero, negative or missing tenure included - counts as the
    longest group, unless ``strict`` asks for a label of its own for those.
    """
    group = F.when(years.between(low, 2), f"tenure{low}-2")
    for label, first, last in TENURE_GROUPS:
        group = group.when(years.between(first, last), label)
    if strict:
        return group.when(years > 8, LONGEST_TENURE).otherwise("unknown")
    return group.otherwise(LONGEST_TENURE)
