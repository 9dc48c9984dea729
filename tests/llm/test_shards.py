import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from crossbasket.llm import shards


def test_every_row_once_in_gapless_slots(awkward):
    rows = shards.report(awkward).collect()
    texts = Counter()
    for r in awkward.collect():
        data = (r["text"] or "").encode()
        texts[(r["doc_id"], len(data) + 16, zlib.crc32(data))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) == 1 and all(r["slot"] == 0 for r in rows)  # fewer rows than shards
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_shards_and_cells(spark):
    df = spark.range(0, 1003, 1, 5).selectExpr("id AS doc_id", "id % 3 AS shard")
    rows = shards.uniform_shards(df, shards=7, cell_rows=20).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1003))
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by.values())) == [143] * 5 + [144] * 2
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = shards.uniform_shards(df, shards=7, cell_rows=20).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_copies_of_one_row_are_dealt_like_others(spark):
    df = spark.range(0, 400, 1, 4).selectExpr("CAST(1 AS LONG) AS doc_id", "'t' AS text")
    counts = Counter(r["shard"] for r in shards.report(df).collect())
    assert set(counts.values()) == {10} and len(counts) == 40


def test_empty_table(nothing):
    assert shards.report(nothing).collect() == []


def test_matrix_has_the_exact_margins():
    blocks = [5, 0, 1, 300, 77]
    matrix = shards.communication_matrix(blocks, 4, 3)
    assert [sum(row) for row in matrix] == blocks
    sizes = [sum(column) for column in zip(*matrix)]
    assert sum(sizes) == sum(blocks) and max(sizes) - min(sizes) <= 1


def test_hypergeometric_draws_follow_the_law():
    rng = random.Random(5)
    draws = [shards.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    mean = sum(draws) / len(draws)
    variance = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert abs(mean - 6) < 0.15
    assert abs(variance - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert shards.hypergeometric(rng, 10**12, 10**13, 10**6) > 0


def test_main_path_has_no_python(awkward):
    plan = shards.report(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_copies_of_a_row_are_shuffled_too(spark):
    """Copies go to different shards as often as different rows do."""
    ids = spark.range(500).selectExpr("explode(array(id, id, id)) AS doc_id").repartition(6)
    spread = shards.uniform_shards(ids, 40).groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).agg(F.avg("n")).first()[0]
    expected = 40 * (1 - (39 / 40) ** 3)
    assert abs(spread - expected) < 0.05
    many = spark.range(1000).selectExpr("explode(array_repeat(id, 40)) AS doc_id").coalesce(1)
    spread = shards.uniform_shards(many, 40).groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).agg(F.avg("n")).first()[0]
    assert abs(spread - 40 * (1 - (39 / 40) ** 40)) < 0.5
