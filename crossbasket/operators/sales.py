"""Sales lines: validity, enrichment, carve-out, scope.

A key that holds a large part of the lines must not leave them to one task. Joins to plain
dims are split by Spark's own skew join, which cuts the lines by measured size, or broadcast
where the dim's size allows; items, which grow with the data, never are. Joins to keys grouped
beforehand are out of its reach and spread the lines explicitly.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbasket.functions.text import category_default, transaction_key, trim_all
from crossbasket.operators.skew import growing, spread_join


def is_valid(flag: str = "valid_tx_flag", void: str = "void_flag") -> Column:
    return (F.col(flag) == 1) & F.col(void).isNull()


def valid_transactions(
    sales: DataFrame, flag: str = "valid_tx_flag", void: str = "void_flag"
) -> DataFrame:
    """Lines marked valid and not voided."""
    return sales.filter(is_valid(flag, void))


def scope(
    sales: DataFrame,
    date_col: str,
    start: dt.date | str,
    end: dt.date | str,
    region_col: str | None = None,
    regions: Sequence[str] = (),
) -> DataFrame:
    """Lines dated from ``start`` to ``end`` inclusive, in one of ``regions``.

    A date column is compared as it is, so the bounds reach the scan; text is read as a date
    and drops the line where it is none.
    """
    typed = dict(sales.dtypes)[date_col] == "date"
    date = F.col(date_col) if typed else F.col(date_col).try_cast("date")
    kept = date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    if region_col is not None:
        kept = kept & F.col(region_col).isin(*regions)
    return sales.filter(kept)


def exclude_brand(sales: DataFrame, brand_col: str, token: str) -> DataFrame:
    """Lines whose brand does not contain ``token``; lines without a brand go too."""
    return sales.filter(~F.col(brand_col).contains(token))


def segment(df: DataFrame, col: str, values: Sequence[str], negate: bool = False) -> DataFrame:
    """Rows whose ``col`` is in ``values`` (or, with ``negate``, is not); NULL is in neither."""
    inside = F.col(col).isin(*values)
    return df.filter(~inside if negate else inside)


def latest_per_key(
    versions: DataFrame, key: str, stamp: str, cols: Sequence[str] | None = None
) -> DataFrame:
    """The distinct versions of each key that carry its latest date.

    All of them are kept on a tie; versions without key or date are dropped. The latest
    dates are aggregated and joined back on key and date, so that no key's versions have to
    meet in one task as they would in a window.
    """
    rows = versions.select(*(cols or versions.columns)).dropna(subset=[key, stamp])
    latest = rows.groupBy(key).agg(F.max(stamp).alias(stamp))
    return rows.join(growing(latest), [key, stamp], "left_semi").distinct()


def resolve_member(member_map: DataFrame, number: str, main: str) -> DataFrame:
    """The smallest main number of each member number that has one."""
    return member_map.filter(F.col(main).isNotNull()).groupBy(number).agg(F.min(main).alias(main))


def member_key(main: Column, number: Column) -> Column:
    """The main number or, without one, the number itself."""
    return F.coalesce(main, number)


def enrich_member(
    sales: DataFrame,
    member_map: DataFrame,
    number: str,
    main: str,
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Adds the resolved member key ``main`` to every line (``hot``, ``by``: see ``spread_join``)."""
    resolved = resolve_member(trim_all(member_map), number, main).withColumnRenamed(main, "_main")
    joined = spread_join(sales, resolved, [number], "left", hot, by)
    return joined.withColumn(main, member_key(F.col("_main"), F.col(number))).drop("_main")


def enrich_sales_b(
    sales: DataFrame,
    brands: DataFrame,
    skus: DataFrame,
    member_map: DataFrame,
    shops: DataFrame,
    categories: DataFrame,
    mapping: DataFrame,
    sku_brand_match: bool = True,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Valid lines with brand, SKU, member key, shop, category and transaction key; distinct.

    Repeated lines go before the joins, while a line is narrow, and so do repeated rows of what is looked up:
    different lines stay different, and a line meets different rows only.

    ``skus`` holds the current versions (``latest_per_key``). With ``sku_brand_match`` a line
    only meets its SKU if its brand code is known to ``brands``. ``hot``: see ``spread_join``.
    """
    lines = trim_all(valid_transactions(sales)).distinct()
    brands = trim_all(brands).withColumnRenamed("brand_code", "prod_brand").distinct()
    lines = lines.join(brands.withColumn("_known", F.lit(True)), ["prod_brand"], "left")
    sku_key = F.when(F.col("_known"), F.col("item_code")) if sku_brand_match else F.col("item_code")
    # what hangs on the SKU is joined to it first, not line by line
    categories = trim_all(categories).withColumnRenamed("maincat_code", "item_cat")
    items = skus.drop("last_modified_date", "brand_code").withColumnRenamed("item_code", "_sku")
    items = items.join(categories, ["item_cat"], "left").join(mapping, ["maincat_desc"], "left")
    items = items.withColumn("arti_cate_name", category_default(F.col("arti_cate_name"))).distinct()
    lines = lines.withColumn("_sku", sku_key).join(growing(items), ["_sku"], "left").drop("_sku", "_known")
    lines = enrich_member(lines, member_map, "vip_no", "vip_main_no", hot, ["invoice_no", "item_code"])
    lines = lines.join(trim_all(shops).distinct(), ["shop_code"], "left")
    return lines.withColumn(
        "sales_main_key", transaction_key(F.col("shop_code"), F.col("invoice_no"))
    ).withColumn("arti_cate_name", category_default(F.col("arti_cate_name")))


def enrich_sales_a(
    sales: DataFrame, stores: DataFrame, mapping: DataFrame, unit_value: str | None = "COS"
) -> DataFrame:
    """Lines with the region and name of their store and a category; distinct.

    With ``unit_value`` only lines of that business unit use the category mapping, the
    others show their unit; without it all lines use the mapping.
    """
    stores = trim_all(stores).withColumnRenamed("store_id", "loc_code").distinct()
    lines = trim_all(sales).distinct().join(stores, ["loc_code"], "left")
    unit = None if unit_value is None else F.col("bu_desc")
    category = category_default(F.col("arti_cate_name"), unit, unit_value or "")
    if set(mapping.columns) != {"category_desc", "arti_cate_name"}:  # other units would show the rest
        return lines.join(mapping, ["category_desc"], "left").withColumn("arti_cate_name", category).distinct()
    # lines of other units meet no category, so a word with several does not repeat them
    word = F.col("category_desc") if unit is None else F.when(unit == unit_value, F.col("category_desc"))
    names = mapping.select(
        F.col("category_desc").alias("_word"), category_default(F.col("arti_cate_name")).alias("arti_cate_name")
    ).distinct()
    mapped = lines.withColumn("_word", word).join(names, ["_word"], "left").drop("_word")
    return mapped.withColumn("arti_cate_name", category)


def carveout_keys(
    sales: DataFrame,
    shop_brand: str,
    region: str,
    odd_date: str,
    dummy_item: str,
) -> DataFrame:
    """Distinct keys of the transactions that belong to the carved-out chain.

    On ``odd_date`` a line also needs a remark that starts with that date. The two cases
    differ in one predicate only, hence one scan with a disjunction.
    """
    odd = F.lit(odd_date).cast("date")
    on_odd_date = (F.col("order_date") == odd) & F.col("invoice_remark").startswith(odd_date)
    return (
        valid_transactions(sales)
        .filter((F.col("shop_brand") == shop_brand) & (F.col("region_key") == region))
        .filter(F.col("item_code") != dummy_item)
        .filter((F.col("order_date") != odd) | on_odd_date)
        .select("sales_main_key")
        .distinct()
    )


def exclude_carveout(
    sales: DataFrame,
    keys: DataFrame,
    key: str = "sales_main_key",
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Lines whose key is not in ``keys``, with the three-valued logic of SQL ``NOT IN``.

    A NULL among the keys empties the result; a line without a key stays only if there are
    no keys at all. The null-aware join Spark plans for ``NOT IN`` works by broadcasting
    the keys, which has no size bound, hence the plain anti join on non-NULL keys.
    """
    n_null = F.count(F.when(F.col(key).isNull(), 1))
    verdict = F.when(n_null > 0, 0).when(F.count(F.lit(1)) > 0, 1).otherwise(2)
    known = keys.select(key).dropna().distinct()
    outside = spread_join(sales, known, [key], "left_anti", hot, by)
    # 0: none may stay, 1: those with a key may, 2: all may
    may_stay = keys.agg(verdict.alias("verdict")).scalar() + F.col(key).isNotNull().cast("int")
    return outside.filter(may_stay >= 2)


def carveout_semi(
    sales: DataFrame,
    keys: DataFrame,
    key: str = "sales_main_key",
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Lines whose key is in ``keys``."""
    return spread_join(sales, keys.select(key).dropna().distinct(), [key], "left_semi", hot, by)


def mark_carveout(
    sales: DataFrame,
    keys: DataFrame,
    key: str = "sales_main_key",
    label: str = "carved_out",
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Both sides of the carve-out from one join: 1 inside, 0 outside, NULL without a key."""
    marked = keys.select(key).dropna().distinct().withColumn("_in", F.lit(1))
    inside = F.when(F.col(key).isNotNull(), F.coalesce(F.col("_in"), F.lit(0)))
    joined = spread_join(sales, marked, [key], "left", hot, by)
    return joined.withColumn(label, inside).drop("_in")


def carveout_sales(
    sales: DataFrame,
    keys: DataFrame,
    mapping: DataFrame,
    key: str = "sales_main_key",
    item: str = "item_subcat_desc",
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The carve-out's lines under its own category mapping, one empty line per key unsold.

    A right join to the keys; written as a semi join plus the keys left over, since the
    side without order (the lines) may hold very large groups.
    """
    wanted = keys.select(key).distinct()
    lines = carveout_semi(sales, wanted, key, hot, by).drop("arti_cate_name").join(mapping, [item], "left")
    unsold = wanted.join(growing(sales.select(key).distinct()), [key], "left_anti")
    return lines.unionByName(unsold, allowMissingColumns=True)


def order_line_rejoin(
    lines: DataFrame,
    raw: DataFrame,
    key: str,
    col: str,
    copies: str = "copies",
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Each line with every value of ``col`` found in the raw lines of its transaction.

    ``copies`` tells how many raw lines carry the value, i.e. how often the plain line-to-line
    join repeats the row; sums weighted by it equal the sums over that join, without writing
    a transaction's lines squared. Without a raw line the value is NULL, in one copy. Raw lines of
    other transactions are left out before anything is counted.
    """
    wanted = lines.select(key).distinct()
    kept = spread_join(raw, wanted, [key], "left_semi", hot, by)
    values = kept.groupBy(key, col).agg(F.count(F.lit(1)).alias(copies))
    joined = lines.drop(col).join(growing(values), [key], "left")
    return joined.withColumn(copies, F.coalesce(F.col(copies), F.lit(1)))


def brand_code_lookup(sales: DataFrame, brands: DataFrame) -> DataFrame:
    """Distinct brand codes sold, with their description where there is one."""
    codes = trim_all(sales.select("prod_brand")).distinct()
    names = trim_all(brands).withColumnRenamed("brand_code", "prod_brand")
    return codes.join(names, ["prod_brand"], "left").select("prod_brand", "brand_desc").distinct()
