"""Rankings, shares and cross tables over labelled sales and matched members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbasket.functions.dates import tenure_group, tenure_labels, tenure_years
from crossbasket.operators.kpi import percent, ratio
from crossbasket.operators.matching import pair_counts
from crossbasket.operators.skew import growing, spread_join


def top_by(sales: DataFrame, dim: str, key: str, n: int | None = None) -> DataFrame:
    """Distinct customers per value of ``dim`` and their percentage of all customers.

    Largest first, ties by name; ``n`` cuts the ranking. Distinct (value, customer) rows are
    formed once, spread over both columns, and serve the counts and the total.
    """
    rows = sales.select(dim, key).distinct()
    total = rows.agg(F.countDistinct(key).alias("n")).scalar()
    ranked = (
        rows.groupBy(dim)
        .agg(F.count(key).alias("count_customer"))
        .withColumn("percentage", percent(F.col("count_customer"), total))
        .orderBy(F.desc("count_customer"), F.asc_nulls_last(dim))
    )
    return ranked if n is None else ranked.limit(n)


def customers_by(
    sales: DataFrame, dims: Sequence[str], key: str, n: int | None = None, name: str = "n_customers"
) -> DataFrame:
    """Distinct customers per combination of ``dims``, largest first, ties by name."""
    rows = sales.select(*dims, key).distinct()
    order = [F.desc(name), *[F.asc_nulls_last(dim) for dim in dims]]
    ranked = rows.groupBy(*dims).agg(F.count(key).alias(name)).orderBy(*order)
    return ranked if n is None else ranked.limit(n)


def customers_by_order_content(
    lines: DataFrame,
    raw: DataFrame,
    order: str,
    dims: Sequence[str],
    key: str,
    n: int | None = None,
    own: Sequence[str] = (),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Customers of ``lines`` by what the raw lines of the same orders contain (``dims``) and,
    if asked, by columns of the lines themselves (``own``).

    Only distinct customers and distinct contents per order meet, not its lines squared; raw
    lines of other orders are left out before that.
    """
    buyers = lines.select(order, key, *own).distinct()
    wanted = buyers.select(order).distinct()
    contents = spread_join(raw.select(order, *dims), wanted, [order], "left_semi", hot, dims).distinct()
    return customers_by(buyers.join(growing(contents), [order], "left"), [*own, *dims], key, n)


def sow_by(sales: DataFrame, dim: str, amount: str = "amt") -> DataFrame:
    """Amount per value of ``dim`` as a share of the whole."""
    sums = sales.groupBy(dim).agg(F.sum(amount).alias("_amt"))
    total = sums.agg(F.sum("_amt").alias("total")).scalar()
    return sums.select(
        dim,
        F.round(F.col("_amt").cast("double"), 4).alias("amt"),
        ratio(F.col("_amt"), total, 6).alias("pct"),
    )


def sow_by_both(a_share: DataFrame, b_share: DataFrame, dim: str) -> DataFrame:
    """Two share tables side by side."""
    left = a_share.select(dim, F.col("pct").alias("pct_a"))
    return left.join(b_share.select(dim, F.col("pct").alias("pct_b")), [dim], "full")


def spend_by(sales: DataFrame, dims: Sequence[str], amount: str = "amt") -> DataFrame:
    total = F.round(F.sum(amount).cast("double"), 4)
    return sales.groupBy(*dims).agg(total.alias("amt"))


def pair_distribution(a: DataFrame, b: DataFrame, attr: str, of_b: bool = False) -> DataFrame:
    """Matched pairs by an attribute of one side, with their share of all pairs."""
    counts = pair_counts(a, b, b_attrs=[attr]) if of_b else pair_counts(a, b, a_attrs=[attr])
    total = counts.agg(F.sum("n_pairs").alias("n")).scalar()
    return counts.withColumn("pct", ratio(F.col("n_pairs"), total, 6))


def pair_matrix(
    a: DataFrame,
    b: DataFrame,
    attr: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Share of the pairs per (``attr`` in A, ``attr`` in B), A down and B across.

    ``columns`` lists the values across where they are known beforehand; without it Spark
    runs a job to find them.
    """
    left = a.withColumnRenamed(attr, f"a_{attr}")
    right = b.withColumnRenamed(attr, f"b_{attr}")
    counts = pair_counts(left, right, [f"a_{attr}"], [f"b_{attr}"])
    total = counts.agg(F.sum("n_pairs").alias("n")).scalar()
    shares = counts.withColumn("pct", ratio(F.col("n_pairs"), total, 6))
    grouped = shares.groupBy(f"a_{attr}")
    across = grouped.pivot(f"b_{attr}", list(columns)) if columns else grouped.pivot(f"b_{attr}")
    return across.agg(F.first("pct"))


def tenure_matrix(a: DataFrame, b: DataFrame, as_of, low: int = 1) -> DataFrame:
    """``pair_matrix`` over the tenure groups of the two members."""

    def grouped(members: DataFrame) -> DataFrame:
        years = tenure_years(F.col("first_purchase"), as_of)
        return members.withColumn("tenure", tenure_group(years, low))

    return pair_matrix(grouped(a), grouped(b), "tenure", tenure_labels(low))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value; missing values are not listed."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def penetration_by_store(
    sales: DataFrame, store: str, label: str, n: int | None = 6
) -> DataFrame:
    """Share of a store's lines that overlapping customers bought, largest first."""
    share = F.round(F.avg(label), 6).alias("penetration")
    ranked = sales.groupBy(store).agg(share)
    ranked = ranked.orderBy(F.desc("penetration"), F.asc_nulls_last(store))
    return ranked if n is None else ranked.limit(n)


def brand_info(
    sales: DataFrame,
    brand: str,
    key: str,
    order: str,
    date: str,
    by_year: bool = False,
) -> DataFrame:
    """Members, transactions and first and last date of each brand, optionally per year.

    Lines shrink to one row for each member and order of a group first; its members and its orders are then
    counted by themselves, each row once, instead of repeating every line for either count.
    """
    groups: dict[str, Column] = {brand: F.col(brand)}
    if by_year:
        groups["year"] = F.year(date)
    names = list(groups)
    rows = sales.select(
        *[c.alias(n) for n, c in groups.items()], F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(date).alias("_date")
    ).groupBy(*names, "_key", "_order").agg(F.min("_date").alias("first"), F.max("_date").alias("last"))

    def counted(what: str, members: bool) -> DataFrame:
        per_value = rows.groupBy(*names, what).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        n, none = F.count(what).alias("n"), F.lit(None).cast("bigint")
        out = per_value.groupBy(*names).agg(n, F.min("first").alias("first"), F.max("last").alias("last"))
        n_member, n_trans = (F.col("n"), none) if members else (none, F.col("n"))
        return out.select(*names, n_member.alias("n_member"), n_trans.alias("n_trans"), "first", "last")

    # one row of either kind for each group
    both = counted("_key", True).unionByName(counted("_order", False))
    return both.groupBy(*names).agg(
        F.max("n_member").alias("n_member"),
        F.max("n_trans").alias("n_trans"),
        F.min("first").alias("min_date"),
        F.max("last").alias("max_date"),
    )


def distinct_values(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Distinct combinations of ``cols`` among the rows that meet ``where``."""
    return (df if where is None else df.filter(where)).select(*cols).distinct()


def sorted_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of one column."""
    return df.select(col).distinct().orderBy(F.asc_nulls_first(col))
