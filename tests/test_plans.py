"""What the plans must and must not contain."""

import os
import re

import pytest

import __spark_entry__ as driver
from pyspark.sql import functions as F

from crossbasket.operators import matching, sales
from crossbasket.operators.labels import label_overlap
from crossbasket.operators.members import active_members
from crossbasket.operators.skew import hot_groups, spread_join
from crossbasket.plans.queries import registered
from crossbasket.sources.roles import Roles

SMALLEST = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_no_query_multiplies_rows_leaves_the_jvm_or_broadcasts_unbounded(spark):
    """No nested loops or products, no single-task windows, no Python per row; and what is
    broadcast regardless of size are the hot groups, cut to a fixed number."""
    banned = "CartesianProduct|NestedLoop|Window|BatchEvalPython|ArrowEvalPython|InPandas"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in registered().items():
            plan = _plan(query(spark, SMALLEST))
            assert not re.findall(banned, plan), name
            # what is broadcast is a table of hot groups, or these counted on the spot
            for broadcast in plan.split("BroadcastExchange")[1:]:
                assert re.search("_salts|_p#", broadcast[:3000]), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_grows_with_the_data_is_not_broadcast_even_where_it_is_small(spark):
    """Members, keys and the source tables are dealt by key at every size; looked at after the run, which
    may turn a join into a broadcast by itself."""
    a = spark.range(200).selectExpr("CAST(id AS STRING) AS a", "CAST(id % 90 AS STRING) AS email", "'' AS mobile")
    b = a.withColumnRenamed("a", "b")
    frames = {
        "pairs by attribute": matching.pair_counts(a.withColumnRenamed("a", "x"), b, ["x"], ["b"]),
        "active members": active_members(a, b.withColumnRenamed("b", "a"), "a"),
        "labels": label_overlap(a, "a", {"in_b": a.select("a").limit(50)}, unique_key=True),
        "spread join": spread_join(a, b, ["email"], by=["a"]),
        "pair join": matching.match_customers(a, b, "a", "b", "a", "b"),
        "current versions": sales.latest_per_key(a, "a", "email"),
    }
    if os.path.isdir(SMALLEST):
        frames["lines of a"] = Roles(spark, SMALLEST).sales_a()
        frames["tenures"] = registered()["tenure_matrix"](spark, SMALLEST)
    for name, df in frames.items():
        assert df.collect(), name
        final = _plan(df).split("== Initial Plan ==")[0]
        for broadcast in final.split("BroadcastExchange")[1:]:
            assert re.search("_salts|_p#", broadcast[:3000]), name


def test_figures_skip_the_folders_of_other_customers(spark):
    if not os.path.isdir(SMALLEST):
        pytest.skip("no test tables")
    plan = _plan(driver.queries()["pricepoint_table"](spark, SMALLEST))
    assert "in_b" in re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1)
    assert "ReadSchema: struct<amt:decimal(18,4),qty:decimal(18,0),arti_cate_name:string>" in plan
    # figures by order read the table of orders, which has no line
    assert re.search(r"ReadSchema: struct<mask:bigint,amt:decimal\(\d+,4\),qty:decimal\(\d+,0\)", _plan(
        driver.queries()["kpi_price_point"](spark, SMALLEST)
    ))


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


def _with(spark, settings):
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    return before


def _restore(spark, before):
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


@pytest.fixture
def lines(spark):
    """Half of the lines share one key."""
    return spark.range(0, 40000, 1, 8).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'hot' ELSE CAST(id % 500 AS STRING) END AS vip_no",
        "id AS amt",
        "'B1' AS prod_brand",
    )


def test_joins_left_to_spark_are_split_on_a_hot_key(spark, lines):
    raw = spark.range(2000).selectExpr(
        "CASE WHEN id < 500 THEN CAST(id AS STRING) ELSE 'hot' END AS vip_no", "id % 3 AS c"
    )
    before = _with(spark, SPLIT)
    try:
        joined = sales.order_line_rejoin(lines, raw, "vip_no", "c")
        joined.collect()
        assert "skew=true" in _plan(joined)
    finally:
        _restore(spark, before)


def test_joins_to_grouped_keys_are_spread(spark, lines):
    """Spark reuses the grouping of the keys and does not split such a join itself."""
    known = spark.range(500).selectExpr("CAST(id AS STRING) AS vip_no", "'m' AS vip_main_no")
    known = known.union(spark.sql("SELECT 'hot', 'm'"))
    no_split = {k: v for k, v in SPLIT.items() if "skewJoin" not in k}
    before = _with(spark, no_split)
    hot = hot_groups(lines, ["vip_no"])
    try:
        for joined in (
            sales.enrich_member(lines, known, "vip_no", "vip_main_no", hot, ["amt"]),
            sales.carveout_semi(lines, known, "vip_no", hot, ["amt"]),
            sales.mark_carveout(lines, known, "vip_no", hot=hot, by=["amt"]),
        ):
            sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
            total = sum(r["count"] for r in sizes)
            assert len(sizes) == 8
            assert max(r["count"] for r in sizes) < total / 3
    finally:
        _restore(spark, before)


def _scans(plan, table):
    return len(re.findall(rf"FileScan parquet .*{table}", plan))


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_no_query_scans_the_raw_lines_more_than_twice(spark):
    for name, query in registered().items():
        assert _scans(_plan(query(spark, SMALLEST)), "lineitem.parquet") <= 2, name


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_joins_read_only_what_a_query_needs(spark):
    queries = registered()
    plan = _plan(queries["issue_intersect"](spark, SMALLEST))
    assert "ReadSchema: struct<vip_main_no:string,shop_code:string" in plan or "item_desc" not in plan
    assert "arti_cate_name" not in plan and "amt" not in plan
    plan = _plan(queries["segment_spend_share"](spark, SMALLEST))
    assert "prod_desc" not in plan and "class_desc" not in plan
    plan = _plan(queries["member_key_resolve"](spark, SMALLEST))
    assert "l_quantity" not in plan and "l_linenumber" not in plan
    plan = _plan(queries["segment_pricepoint"](spark, SMALLEST))
    assert re.search(r"PushedFilters: \[[^\]]*In\(bu_desc", plan)


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_re_joins_reduce_the_raw_lines_first(spark):
    for name in ("order_line_rejoin", "top_subclass", "segment_subclass"):
        plan = registered()[name](spark, SMALLEST)._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Aggregate(?:.*\n){1,3}.*Join LeftSemi", plan), name


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_pair_reports_scan_each_sales_table_once(spark):
    for name in ("pair_report", "pair_report_grid"):
        assert _scans(_plan(registered()[name](spark, SMALLEST)), "/sales_[abc]") <= 4, name


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_the_datamart_is_loaded_not_built_again(spark, monkeypatch):
    from crossbasket.plans import mart

    built = mart.mart_for(spark, SMALLEST)
    monkeypatch.setattr(mart, "build_mart", lambda *_: pytest.fail("built again"))
    monkeypatch.setattr(mart, "_OPEN", {})  # as a new application would start
    assert mart.mart_for(spark, SMALLEST).root == built.root


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_lines_do_not_multiply_with_the_carve_outs_mapping(spark):
    """A repeated mapping row changes nothing; a second category doubles lines of C, none of B's."""
    from crossbasket.plans import mart
    from crossbasket.sources.roles import Roles

    class Mapped(Roles):
        def __init__(self, spark, change):
            super().__init__(spark, SMALLEST)
            self.change = change

        def subcat_codes(self):
            codes = self._table("part").selectExpr(
                "split_part(p_name, ' ', 2) AS item_subcat_desc", "1 AS arti_cate_code"
            ).distinct()
            return self.change(codes)

    def lines(change):
        roles = Mapped(spark, change)
        scoped = mart.scoped_sales_bc(roles, mart.Scope(), mart.keys_of_c(roles), {})
        return {r["carved_out"]: r["count"] for r in scoped.groupBy("carved_out").count().collect()}

    once = lines(lambda codes: codes)
    assert once[0] and once[1]
    assert lines(lambda codes: codes.union(codes)) == once
    twice = lines(lambda codes: codes.union(codes.withColumn("arti_cate_code", F.lit(2))))
    assert twice[0] == once[0] and twice[1] == 2 * once[1]


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_a_build_joins_the_raw_lines_of_each_chain_once(spark, tmp_path):
    from crossbasket.plans import mart

    joined = []

    class Counted(Roles):
        def _lines(self):
            joined.append(1)
            return super()._lines()

    built = mart.build_mart(spark, Counted(spark, SMALLEST), str(tmp_path / "mart"))
    assert len(joined) == 2
    assert not (tmp_path / "mart" / "raw_b").exists()
    keys = mart.keys_of_c(Roles(spark, SMALLEST))
    assert not keys.exceptAll(built.tables["keys_c"]).take(1) and not built.tables["keys_c"].exceptAll(keys).take(1)


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_opening_a_datamart_runs_no_job(spark, monkeypatch):
    from crossbasket.plans import mart

    mart.mart_for(spark, SMALLEST)
    for opened in ({}, mart._OPEN):
        monkeypatch.setattr(mart, "_OPEN", opened)
        spark.sparkContext.setJobGroup("opening", "opening")
        found = mart.mart_for(spark, SMALLEST)
        found.chain("a"), found.unique("a", "b"), found.members("c")
        assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("opening"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_reports_of_all_pairs_scan_each_table_once(spark):
    for name, sales, members in (("pair_demo_report", 3, 2), ("pair_price_report", 3, 0)):
        plan = registered()[name](spark, SMALLEST)._jdf.queryExecution().optimizedPlan().toString()
        assert _leaves(plan) == sales + members, name


def _leaves(plan):
    return sum(bool(re.search(r"Relation \[", line)) for line in plan.splitlines())


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_order_figures_count_no_lines(spark):
    for name in ("kpi_aov", "kpi_upt", "sales_behavior", "pair_report", "share_of_wallet"):
        plan = registered()[name](spark, SMALLEST)._jdf.queryExecution().optimizedPlan().toString()
        relations = re.findall(r"Relation \[([^\]]*)", plan)
        assert not any("in_b#" in r or "in_a#" in r for r in relations) and "count(distinct" not in plan.lower(), name
