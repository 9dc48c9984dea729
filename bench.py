"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of local cores. Every
query runs to its last row; a query's figure is the median of three runs after one to warm
up. ``mart_build`` is the time to write the datamart the figures are computed from, taken
twice: cold (the first work of the JVM) and warm (once more, afterwards). ``value`` is the sum of
the warm build and all queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from crossbasket.plans.mart import build_mart, mart_for
from crossbasket.plans.queries import registered
from crossbasket.session import build_session, scratch
from crossbasket.sources.roles import Roles

HEADLINE = (
    "golden_record_a",
    "enrich_sales",
    "exclude_carveout",
    "active_members",
    "member_key_resolve",
    "match_customers",
    "unique_customers",
    "label_overlap",
    "kpi_aov",
    "sales_behavior",
    "pair_report",
    "share_of_wallet",
    "pricepoint_table",
    "top_brand",
    "top_subclass",
    "tier_matrix",
    "brand_segments",
    "cohort_retention",
    "issue_counts",
    "order_line_rejoin",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(work) -> float:
        start = time.perf_counter()
        work()
        return time.perf_counter() - start

    seconds: dict[str, float] = {}
    cold = timed(lambda: mart_for(spark, folder))
    queries = registered()
    for name in HEADLINE:
        def run() -> None:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(RUNS)), 3)
    seconds["mart_build"] = round(
        timed(lambda: build_mart(spark, Roles(spark, folder), scratch(spark))), 3
    )
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "datamart build and headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "mart_build_cold": round(cold, 3),
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
