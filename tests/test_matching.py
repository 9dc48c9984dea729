"""Matching against the literal definition: a join with a disjunction."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crossbasket.operators import members
from crossbasket.operators.cohort import cohort_retention, pivot_retention
from crossbasket.operators.labels import label_fanout, label_overlap, segment_keys
from crossbasket.operators.matching import (
    count_unique_customers,
    match_customers,
    overlap_keys,
    pair_counts,
    pairs_per_member,
    smallest_partners,
    unique_customers,
)
from crossbasket.operators.profile import pair_distribution, pair_matrix, tenure_matrix

SCHEMA = "key string, email string, mobile string, tier string, sex string"


def _members(prefix, n, seed):
    """Members with few contacts, so that many share one and a third share one phone."""
    pick = random.Random(seed)
    emails = [None, "", *[f"e{i}" for i in range(15)]]
    mobiles = ["", *[f"m{i}" for i in range(15)]]
    return [
        (
            f"{prefix}{i:03}",
            pick.choice(emails),
            "hot" if pick.random() < 0.33 else pick.choice(mobiles),
            pick.choice(["x", "y", None]),
            pick.choice(["F", "M", None]),
        )
        for i in range(n)
    ]


@pytest.fixture(scope="module", params=[1, 2])
def chains(spark, request):
    a = spark.createDataFrame(_members("a", 40, request.param), SCHEMA)
    b = spark.createDataFrame(_members("b", 50, request.param + 10), SCHEMA)
    return a.cache(), b.cache()


def _literal_pairs(a, b):
    same_email = (F.col("a.email") != "") & (F.col("a.email") == F.col("b.email"))
    same_mobile = (F.col("a.mobile") != "") & (F.col("a.mobile") == F.col("b.mobile"))
    return a.alias("a").join(b.alias("b"), same_email | same_mobile).select(
        F.col("a.key").alias("a_key"),
        F.col("b.key").alias("b_key"),
        F.lit("a_b").alias("overlap_name"),
        F.col("a.email").alias("a_email"),
        F.col("b.email").alias("b_email"),
        F.col("a.mobile").alias("a_mobile"),
        F.col("b.mobile").alias("b_mobile"),
        F.col("a.tier").alias("a_tier"),
        F.col("b.tier").alias("b_tier"),
        F.col("a.sex").alias("sex"),
    ).distinct()


def test_match_rules(spark, rows):
    a = spark.createDataFrame(
        [("a1", "", "1"), ("a2", None, ""), ("a3", "e", "2"), ("a3", "e", "2"), ("a4", "f", "")],
        "key string, email string, mobile string",
    )
    b = spark.createDataFrame(
        [("b1", "", ""), ("b2", None, "1"), ("b3", "e", "2"), ("b4", "f", "9"), ("b5", "e", "3")],
        "key string, email string, mobile string",
    )
    pairs = match_customers(a, b, "key", "key", "a", "b", with_contacts=False)
    assert rows(pairs.drop("overlap_name")) == [
        ("a1", "b2"),
        ("a3", "b3"),
        ("a3", "b5"),
        ("a4", "b4"),
    ]


def test_pairs_equal_the_disjunctive_join(chains, rows):
    a, b = chains
    got = match_customers(a, b, "key", "key", "a", "b")
    expected = _literal_pairs(a, b).select(*got.columns)
    assert rows(got) == rows(expected)


def test_an_email_never_meets_the_same_text_as_mobile(spark, rows):
    a = spark.createDataFrame([("a1", "7", "8"), ("a2", "x", "x")], "key string, email string, mobile string")
    b = spark.createDataFrame([("b1", "8", "7"), ("b2", "x", "y"), ("b3", "y", "x")], "key string, email string, mobile string")
    pairs = match_customers(a, b, "key", "key", "a", "b", with_contacts=False)
    assert rows(pairs.drop("overlap_name")) == [("a2", "b2"), ("a2", "b3")]


def test_pairs_of_both_contacts_come_from_one_join(chains):
    """The members of a side are dealt once for both contacts, with the pairs' own number of tasks."""
    plan = match_customers(*chains, "key", "key", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_everything_derived_equals_the_pair_list(chains, rows):
    a, b = chains
    pairs = _literal_pairs(a, b).cache()
    assert rows(overlap_keys(a, b, "key")) == rows(pairs.select("a_key").distinct())
    assert rows(pairs_per_member(a, b, "key")) == rows(pairs.groupBy("a_key").count())
    assert pair_counts(a, b).first()[0] == pairs.count()
    by_tier = pair_counts(
        a.withColumnRenamed("tier", "a_tier"),
        b.withColumnRenamed("tier", "b_tier"),
        ["a_tier"],
        ["b_tier"],
    )
    assert rows(by_tier) == rows(pairs.groupBy("a_tier", "b_tier").count())
    unique = unique_customers(a, b, "key", "key").first()[0]
    assert unique == count_unique_customers(pairs, "a_key", "b_key").first()[0]
    assert unique <= pairs.select("a_key").distinct().count()
    partners = smallest_partners(b, "key", {"a": (a, "key"), "b": (b, "key")})
    firsts = pairs.groupBy("b_key").agg(F.min("a_key"))
    got = partners.filter(F.col("a").isNotNull()).select("key", "a")
    assert rows(got) == rows(firsts)


def test_no_pairs(chains):
    a, b = chains
    none = b.filter(F.lit(False))
    assert pair_counts(a, none).first()[0] == 0
    assert unique_customers(a, none, "key", "key").first()[0] == 0
    assert pairs_per_member(a, none, "key").count() == 0


def test_shares_over_pairs(chains, rows):
    a, b = chains
    pairs = _literal_pairs(a, b)
    total = pairs.count()
    expected = [(r["sex"], r["count"], round(r["count"] / total, 6))
                for r in pairs.groupBy("sex").count().collect()]
    got = rows(pair_distribution(a, b, "sex"))
    assert got == sorted(expected, key=lambda r: (r[0] is None, str(r[0])))
    matrix = pair_matrix(a, b, "tier")
    cells = [v for row in matrix.drop("a_tier").collect() for v in row if v is not None]
    assert sum(cells) == pytest.approx(1, abs=1e-5)
    fixed = pair_matrix(a, b, "tier", ["y", "x"])
    assert fixed.columns == ["a_tier", "y", "x"]


def test_tenure_matrix(chains):
    a, b = (df.withColumn("first_purchase", F.lit("2000-01-01").cast("date")) for df in chains)
    rows = tenure_matrix(a, b, "2003-12-31").collect()
    assert [r.asDict() for r in rows] == [
        {
            "a_tenure": "tenure3-4",
            "tenure1-2": None,
            "tenure3-4": 1.0,
            "tenure5-6": None,
            "tenure7-8": None,
            "tenure>8": None,
        }
    ]


def test_label_overlap_collapses_rows_and_gathers_labels(spark, rows):
    lines = spark.createDataFrame(
        [("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3)], "k string, v int"
    )
    one = spark.createDataFrame([("a",), ("a",), ("z",)], "x string")
    two = spark.createDataFrame([("b",), ("a",)], "y string")
    got = label_overlap(lines, "k", {"one": one, "two": two})
    assert rows(got) == [("a", 1, 1, 1), ("b", 2, 0, 1), (None, 3, 0, 0)]
    kept = label_overlap(lines, "k", {"one": one}, dedup_rows=False)
    assert rows(kept) == [("a", 1, 1), ("a", 1, 1), ("b", 2, 0), (None, 3, 0), (None, 3, 0)]


def test_fanout_weights_equal_the_repeated_lines(chains, spark):
    a, b = chains
    lines = a.select("key", F.explode(F.array(F.lit(1), F.lit(2), F.lit(2))).alias("amt"))
    pairs = _literal_pairs(a, b).select("a_key", "b_key")
    plain = lines.join(pairs, lines.key == pairs.a_key, "left").groupBy(
        F.col("b_key").isNotNull().cast("int").alias("label")
    ).agg(F.count(F.lit(1)), F.sum("amt"))
    got = label_fanout(lines, "key", pairs_per_member(a, b, "key"), "label")
    weighted = got.groupBy("label").agg(F.sum("copies"), F.sum(F.col("amt") * F.col("copies")))
    assert sorted(map(tuple, weighted.collect())) == sorted(map(tuple, plain.collect()))


def test_segment_keys(spark, rows):
    buyers = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    matched = spark.createDataFrame([("b",), ("c",)], "m string")
    assert rows(segment_keys(buyers, matched, "k", True)) == [("b",)]
    assert rows(segment_keys(buyers, matched, "k", False)) == [("a",)]


def _literal_retention(pairs, lists):
    """Full outer joins in plain Python."""
    one_a, one_b, two_a, two_b = lists
    first = [(a, b) for a, b in pairs if a not in one_a]
    first = [(None, b) for _, b in first]
    first += [(a, b) for a, b in pairs if a in one_a]
    first += [(a, None) for a in one_a - {a for a, _ in pairs}]
    both = {(a, b if b in one_b else None) for a, b in first}
    both |= {(None, b) for b in one_b - {b for _, b in first}}
    both.discard((None, None))
    counts = {}

    def label(a, b):
        return "both" if a and b else "a_only" if a else "b_only" if b else "inactive"

    for a, b in both:
        key = (label(a, b), label(a in two_a, b in two_b))
        counts[key] = counts.get(key, 0) + 1
    return counts


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_cohort_retention_equals_full_outer_joins(chains, spark, seed):
    a, b = chains
    pick = random.Random(seed)
    a_keys = [r["key"] for r in a.collect()] + ["a900", "a901"]
    b_keys = [r["key"] for r in b.collect()] + ["b900", "b901"]
    lists = [
        set(pick.sample(keys, size))
        for keys, size in ((a_keys, 15), (b_keys, 20), (a_keys, 20), (b_keys, 15))
    ]
    frames = [spark.createDataFrame([(k,) for k in [*keys, None]], "k string") for keys in lists]
    got = cohort_retention(a, b, "key", "key", frames[0], frames[1], frames[2], frames[3])
    pairs = {(r["a_key"], r["b_key"]) for r in _literal_pairs(a, b).collect()}
    expected = _literal_retention(pairs, lists)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == expected
    grid = pivot_retention(got).collect()
    assert sum(v or 0 for row in grid for v in row[1:]) == sum(expected.values())


@pytest.mark.parametrize("largest", [1, 40])
def test_fetched_attribute_repeats_as_a_self_join_does(spark, rows, largest):
    rng = random.Random(largest)
    raw = [(rng.choice(["k1", "k2", "k3", None]), rng.choice(["x", "y", None]), rng.choice(["10", "20", None])) for _ in range(30)]
    raw += [("hot", "x", str(i % 5)) for i in range(largest)] + [("alone", "x", "1")]
    source = spark.createDataFrame(raw[:-1], "key string, other string, age string")
    left = spark.createDataFrame(raw, "key string, other string, age string")
    got = members.fetch_attribute(left, source, "key", "age")
    literal = [
        (k, o, age)
        for k, o, _ in raw
        for age in ([a for key, _, a in raw[:-1] if key == k and k is not None] or [None])
    ]
    counted = Counter(literal)
    assert {tuple(r)[:3]: r["copies"] for r in got.collect()} == counted
    assert rows(members.repeated(got)) == sorted(literal, key=lambda r: [(v is None, str(v)) for v in r])
