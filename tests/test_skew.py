import pytest
from pyspark.sql import functions as F

from crossbasket.operators import matching
from crossbasket.operators.skew import CELLS_PER_TASK, hot_groups, hot_pairs, pair_join, spread_join


@pytest.fixture
def skewed(spark):
    """3,000 rows: a third with one key, a sixth without any, the rest spread; with copies."""
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").when(F.col("id") < 1500, None)
        .otherwise((F.col("id") % 300).cast("string")).alias("k"),
        (F.col("id") % 7).alias("v"),
    )
    return df.repartition(6)


@pytest.fixture
def looked_up(spark):
    names = [("hot", 1), ("hot", 2), ("1", 3), ("2", 4), ("2", 5), (None, 6), ("absent", 7)]
    return spark.createDataFrame(names, "k string, w int")


def test_hot_groups_are_those_above_an_even_share_and_bounded(spark, skewed):
    """4 partitions of 2,500 rows with a key: a share is 625, which only one group exceeds."""
    hot = hot_groups(skewed, ["k"]).collect()
    assert [(r["k"], r["_salts"]) for r in hot] == [("hot", 2)]
    many = spark.range(1000).selectExpr("CAST(id % 3 AS STRING) AS k")
    assert hot_groups(many, ["k"]).count() <= 4
    assert hot_groups(skewed.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("by", [(), ("v",)])
def test_spread_join_equals_plain_join(skewed, looked_up, rows, how, by):
    expected = skewed.join(looked_up, ["k"], how)
    for hot in (None, hot_groups(skewed, ["k"])):
        got = spread_join(skewed, looked_up, ["k"], how, hot, by)
        assert got.columns == expected.columns
        assert rows(got) == rows(expected)


def test_spread_join_with_the_groups_of_another_frame(spark, skewed, looked_up, rows):
    """Whatever the groups are taken from, the result is the same."""
    expected = rows(skewed.join(looked_up, ["k"], "left"))
    odd = spark.createDataFrame([("2", 3), ("absent", 2), ("hot", 7)], "k string, _salts long")
    for hot in (hot_groups(looked_up, ["k"]), hot_groups(skewed.limit(0), ["k"]), odd):
        assert rows(spread_join(skewed, looked_up, ["k"], "left", hot, ["v"])) == expected


def test_spread_join_on_two_columns(skewed, rows):
    other = skewed.distinct().withColumn("w", F.lit(1))
    got = spread_join(skewed, other, ["k", "v"], "left")
    assert rows(got) == rows(skewed.join(other, ["k", "v"], "left"))


def test_spread_join_reads_and_filters_no_more_than_a_plain_one(spark, tmp_path):
    spark.range(100).selectExpr("id % 5 AS k", "id AS v", "id * 2 AS unused", "id % 3 AS f").write.parquet(f"{tmp_path}/l")
    spark.range(5).selectExpr("id AS k", "id AS w").write.parquet(f"{tmp_path}/r")
    left, right = (spark.read.parquet(f"{tmp_path}/{x}") for x in "lr")
    hot = spark.createDataFrame([(1, 2)], "k long, _salts long")
    joined = spread_join(left, right.distinct(), ["k"], "left", hot, ["v"]).filter("f = 1").select("v", "w")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan
    assert "EqualTo(f,1)" in plan


def test_pair_join_equals_plain_join(spark, rows):
    left = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE CAST(id % 20 AS STRING) END AS k", "id AS a")
    right = spark.range(200).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE CAST(id % 30 AS STRING) END AS k", "id AS b")
    assert [r["k"] for r in hot_pairs(left, right, ["k"]).collect()] == ["hot"]
    assert rows(pair_join(left, right, ["k"], ["a"], ["b"])) == rows(left.join(right, ["k"]))


def test_the_pairs_of_one_contact_fill_all_tasks(spark):
    """3,000 members on either side share a phone: 9 million pairs."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        def side(key):
            return spark.range(3000).selectExpr(f"id AS {key}", "CAST(NULL AS STRING) AS email", "'1' AS mobile")

        pairs = matching.match_customers(side("x"), side("y"), "x", "y", "a", "b", False)
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 9_000_000
        assert len(sizes) == 8 and max(sizes) < 9_000_000 / 3
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_the_pairs_of_one_contact_keep_their_tasks_though_their_rows_are_small(spark):
    """Spark merges shuffle partitions by the bytes read, here a few MB for 9 million pairs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        def side(key):
            # a literal would be taken out of the join's keys
            return spark.range(3000).selectExpr(
                f"id AS {key}", "CAST(NULL AS STRING) AS email", "IF(id >= 0, '1', '2') AS mobile"
            )

        pairs = matching.match_customers(side("x"), side("y"), "x", "y", "a", "b", False)
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 9_000_000
        assert len(sizes) == 8 and max(sizes) < 9_000_000 / 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_cells_of_a_contact_are_dealt_in_turn(spark):
    """Hashed to tasks, some got several times the cells of others."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        left = spark.range(3000).selectExpr("IF(id >= 0, '1', '2') AS k", "id AS a")
        pairs = pair_join(left, left.withColumnRenamed("a", "b"), ["k"], ["a"], ["b"])
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 9_000_000 and len(sizes) == 16
        assert max(sizes) < 1.4 * 9_000_000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pair_join_deals_a_key_that_is_large_on_one_side(spark, rows):
    """Many rows without a partner, or with a single one, are cut too, into no more parts than cells are asked for."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = spark.range(9000).selectExpr("CASE WHEN id < 4000 THEN 'none' WHEN id < 8000 THEN 'one' ELSE 'k' || id END AS k", "id AS a")
    right = spark.range(500).selectExpr("CASE WHEN id = 0 THEN 'one' ELSE 'k' || CAST(8000 + id AS STRING) END AS k", "id AS b")
    for x, y, wide in ((left, right, "_p"), (right, left, "_q")):
        hot = {r["k"]: r for r in hot_pairs(x, y, ["k"]).collect()}
        assert sorted(hot) == ["none", "one"]
        assert all(1 < r[wide] <= CELLS_PER_TASK * parts for r in hot.values())
        assert all(r["_p"] * r["_q"] <= CELLS_PER_TASK * parts for r in hot.values())
    assert rows(pair_join(left, right, ["k"], ["a"], ["b"])) == rows(left.join(right, ["k"]))


def test_spread_join_deals_copies_and_null_keys_over_tasks(spark):
    """One group of identical rows, and keyless rows, must not end up in one partition."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copies = spark.range(0, 4000, 1, 8).select(
            F.when(F.col("id") % 2 == 0, "hot").alias("k"), F.lit(0).alias("v")
        )
        right = spark.createDataFrame([("hot", 1), ("b", 2)], "k string, w int").distinct()
        joined = spread_join(copies, right, ["k"], "left")
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in sizes) == 4000
        assert max(r["count"] for r in sizes) < 3000
        assert len(sizes) >= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_spread_join_refuses_joins_that_keep_right_rows(skewed, looked_up):
    with pytest.raises(ValueError, match="right"):
        spread_join(skewed, looked_up, ["k"], "right")
