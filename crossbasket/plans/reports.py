"""Reports over all chain pairs, in long form with a ``pair`` column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbasket.operators import kpi
from crossbasket.plans.mart import REPORT_PAIRS, UNIT_SLICE, Mart, Scope, key_of


def _sides() -> list[tuple[str, str, str]]:
    """Name (pair and side), side and the chain whose customers count there, of both sides of all pairs."""
    return [(f"{a}_{b}/{side}", side, other) for a, b in REPORT_PAIRS for side, other in ((a, b), (b, a))]


def _named(df: DataFrame) -> DataFrame:
    """``pair`` and ``side`` out of ``name``."""
    parts = F.split("name", "/")
    return df.withColumns({"pair": parts[0], "side": parts[1]}).drop("name")


def _table_of(side: str) -> str:
    """The unit's lines are lines of chain A."""
    return "a" if side == UNIT_SLICE else side


def _by_sales(mart: Mart, side_condition: Callable[[str, str], Column], count: Callable[..., DataFrame]) -> DataFrame:
    """``count`` of each sales table, once, with the conditions of all sides it takes part in."""
    cases: dict[str, dict[str, Column]] = {"a": {}, "b": {}, "c": {}}
    for name, side, other in _sides():
        cases[_table_of(side)][name] = side_condition(side, other)
    return reduce(DataFrame.unionByName, [count(mart, table, cases[table]) for table in cases])


def _labelled_line(side: str, other: str) -> Column:
    condition = F.col(f"in_{other}") == 1
    return condition & (F.col("bu_desc") == Scope().unit) if side == UNIT_SLICE else condition


def pair_totals(mart: Mart) -> DataFrame:
    """Amount, units and orders of the overlapping customers: pair, side, amt, qty, orders.

    Sums over the parts of the orders, one scan of each table of them.
    """
    cases: dict[str, dict[str, int]] = {"a": {}, "b": {}, "c": {}}
    for name, side, other in _sides():
        cases[_table_of(side)][name] = mart.chain(side).bits[f"in_{other}"]
    tables = [kpi.order_totals(mart.tables[f"orders_{t}"], cases[t]) for t in cases]
    return _named(reduce(DataFrame.unionByName, tables)).select("pair", "side", "amt", "qty", "orders")


def pair_report(mart: Mart) -> DataFrame:
    """Sales figures: pair, side, metric, value."""
    return kpi.behavior_metrics(pair_totals(mart).join(mart.n_unique, ["pair"], "left"))


def demo_report(mart: Mart, as_of: str) -> DataFrame:
    """Penetration and tenure shares: pair, side, metric, pct. One scan of each sales and each member table."""

    def buyers(mart: Mart, table: str, sides: dict[str, Column]) -> DataFrame:
        unit = F.col("bu_desc") == Scope().unit
        everyone = {f"{n}/all": unit if n.endswith(f"/{UNIT_SLICE}") else F.lit(True) for n in sides}
        overlapping = {f"{n}/overlap_customers": condition for n, condition in sides.items()}
        return kpi.count_keys_by_mask(mart.tables[f"sales_{table}"], key_of(table), overlapping | everyone)

    def members(table: str, chains: tuple[str, ...]) -> DataFrame:
        conditions: dict[str, Column] = {}
        groups = kpi.tenure_conditions(as_of)
        for name, side, other in _sides():
            if side in chains:
                here = (F.col(f"active_{side}") == 1) & F.col(f"in_{other}").isNotNull()
                conditions |= {f"{name}/{group}": here & condition for group, condition in groups.items()}
                conditions[f"{name}/all"] = here
        return kpi.count_keys_by_mask(mart.tables[f"members_{table}"], key_of(table), conditions)

    parts = F.split("name", "/")

    def shares(counts: DataFrame) -> DataFrame:
        """Each count as a percentage of the side's count of all."""
        split = counts.select(parts[0].alias("pair"), parts[1].alias("side"), parts[2].alias("metric"), "n")
        everyone = F.col("metric") == "all"
        # a few rows for each side
        sides = split.groupBy("pair", "side").agg(
            F.max(F.when(everyone, F.col("n"))).alias("whole"),
            F.collect_list(F.when(~everyone, F.struct("metric", "n"))).alias("counts"),
        )
        rows = sides.select("pair", "side", "whole", F.inline("counts"))
        return rows.select("pair", "side", "metric", kpi.percent(F.col("n"), F.col("whole")).alias("pct"))

    bought = shares(_by_sales(mart, _labelled_line, buyers))
    joined = members("a", ("a", UNIT_SLICE)).unionByName(members("b", ("b", "c")))
    return bought.unionByName(shares(joined))


def wallet_report(mart: Mart) -> DataFrame:
    """Shares of wallet: pair, side, sales, share_pct."""
    totals = pair_totals(mart)
    both = totals.groupBy("pair").agg(F.when(F.count("amt") == 2, F.sum("amt")).alias("both"))
    return totals.join(both, ["pair"]).select(
        "pair",
        "side",
        F.round(F.col("amt").cast("double"), 4).alias("sales"),
        kpi.percent(F.col("amt"), F.col("both")).alias("share_pct"),
    )


def price_report(mart: Mart, category: str = "arti_cate_name") -> DataFrame:
    """Price points by category: pair, category and one price per side. One scan of each sales table."""

    def priced(mart: Mart, table: str, sides: dict[str, Column]) -> DataFrame:
        return kpi.sums_by_mask(mart.tables[f"sales_{table}"], category, sides)

    sums = _named(_by_sales(mart, _labelled_line, priced))
    price = kpi.ratio(F.col("amt"), F.col("qty"), 2)
    first = F.col("side") == F.element_at(F.split("pair", "_"), 1)
    rows = sums.select("pair", F.col(category).alias("category"), first.alias("first"), price.alias("price"))
    # one row of either side at most; as in a full join, a missing category equals no other
    alone = F.when(F.col("category").isNull(), F.col("first")).alias("alone")
    return rows.groupBy("pair", "category", alone).agg(
        F.max(F.when(F.col("first"), F.col("price"))).alias("first_price_point"),
        F.max(F.when(~F.col("first"), F.col("price"))).alias("second_price_point"),
    ).drop("alone")


def as_grid(report: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """A long report with one column per metric."""
    grouped = report.groupBy("pair", "side")
    across = grouped.pivot("metric", metrics) if metrics else grouped.pivot("metric")
    return across.agg(F.first("value"))
