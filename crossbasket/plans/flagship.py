"""The shortest way through every stage, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crossbasket.operators import kpi, labels, matching, members, sales
from crossbasket.plans.mart import Scope, golden_a, golden_b
from crossbasket.sources.roles import Roles


def average_order_value(roles: Roles, what: Scope = Scope()) -> DataFrame:
    """Average order value in chain A of the customers who also shop in chain B.

    All regions; B includes its carve-out. Only A's customers have to be marked, and they
    are active by being in the lines, so A's members need no activity check of their own.
    """
    lines = sales.scope(roles.sales_a(), "order_date", what.start, what.end)
    lines_b = sales.scope(
        sales.valid_transactions(roles.sales_b()), "order_date", what.start, what.end
    )
    lines_b = sales.enrich_member(lines_b, roles.member_map(), "vip_no", "vip_main_no")
    active_b = members.active_members(golden_b(roles), lines_b, "vip_main_no")
    shared = matching.overlap_keys(golden_a(roles), active_b, "vip_no")
    marked = labels.label_overlap(lines, "vip_no", {"in_b": shared})
    chain = kpi.Chain("a", marked, golden_a(roles), "vip_no", "order_no")
    return kpi.aov(chain, "in_b")
