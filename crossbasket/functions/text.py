"""Text columns: trimming, labels and composite keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OTHER_CATEGORY = "others"


def trim_all(df: DataFrame, cols: Iterable[str] | None = None, stringify: bool = False) -> DataFrame:
    """Trim text columns in one projection, so typed columns keep their type and pushdown.

    ``stringify`` turns every chosen column into trimmed text instead.
    """
    wanted = set(df.columns if cols is None else cols)

    def trimmed(field: T.StructField) -> str:
        name = "`" + field.name.replace("`", "``") + "`"
        text = isinstance(field.dataType, T.StringType)
        if field.name in wanted and (text or stringify):
            return f"trim(CAST({name} AS STRING)) AS {name}"
        return name

    return df.selectExpr(*[trimmed(field) for field in df.schema.fields])


def category_default(mapped: Column, unit: Column | None = None, unit_value: str = "COS") -> Column:
    """The mapped category or ``others``.

    With ``unit`` given, only lines of ``unit_value`` use the mapping and all others show
    their business unit as the category.
    """
    category = F.coalesce(mapped, F.lit(OTHER_CATEGORY))
    return category if unit is None else F.when(unit == unit_value, category).otherwise(unit)


def transaction_key(shop: Column, invoice: Column) -> Column:
    """``shop-invoice``; NULL if either part is."""
    return F.concat(shop, F.lit("-"), invoice)


def labelled(*parts: Column) -> Column:
    """Parts joined with a dash; NULL if any part is."""
    joined = [parts[0]]
    for part in parts[1:]:
        joined += [F.lit("-"), part]
    return F.concat(*joined)
