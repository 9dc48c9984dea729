"""Joins that stay even when one key holds a large part of the rows.

Spark splits a skewed join input by itself, but only where both inputs are shuffled for the
join alone. Where the other side is grouped by the join key - distinct keys, one row per
member - its grouping is reused, and a hot key's rows all go to one task. ``spread_join`` is
for those joins; ``pair_join`` is for joins whose result grows with the product of a key's rows.

A key is hot if it holds more than one task's even share, of the rows or of the pairs. There are fewer
such keys than shuffle partitions, whatever the size of the data, so a table of them is safe to
broadcast. Where a join's left side is costly, that table is written once and handed in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells per task that a hot key's pairs are cut into, so that their hashes fill all tasks.
CELLS_PER_TASK = 8


def growing(df: DataFrame) -> DataFrame:
    """A join side that grows with the data: it is dealt by key, never sent whole through the driver.

    Spark takes what a scan has on disk, packed, for its size in memory, and guesses what follows an
    aggregate, so what it would broadcast may be many times its threshold.
    """
    return df.hint("merge")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _any_null(on: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(name).isNull() for name in on])


def _deal(by: Sequence[str], parts: Column) -> Column:
    """A part for each row; without columns to tell rows apart, by the task that holds it."""
    return F.pmod(F.xxhash64(*by) if by else F.spark_partition_id().cast("bigint"), parts)


def _numbers(parts: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.coalesce(parts, F.lit(1).cast("bigint")) - 1)


def hot_groups(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The groups larger than a shuffle partition's even share, and into how many parts to cut each.

    Fewer than there are shuffle partitions; sizes are counted on the map side first.
    """
    parts = _partitions(df)
    sizes = df.filter(~_any_null(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = sizes.agg(F.sum("_rows").alias("n")).scalar()
    share = F.col("_rows") * F.lit(parts) / total
    return sizes.filter(share > 1).select(*on, F.ceil(share).cast("bigint").alias("_salts"))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Equi-join on the columns ``on`` in which ``left`` may hold very large groups.

    Rows of a hot group are dealt to as many parts as its size asks for, by a hash of the few
    columns ``by`` that tell its rows apart; the rows of ``right`` with that key are repeated once
    per part and no other rows are. Rows with a NULL key never match and are dealt evenly. No
    other column is read for this, and filters on the result reach both inputs. ``right`` has keys and
    grows with them, so it is never broadcast.

    ``hot`` is a table from ``hot_groups``, written before, of ``left`` or of a frame with much the
    same groups; the result does not depend on it. Without one, groups are counted on ``left``,
    which must then be repeatable. ``how`` may be any type that keeps no unmatched right rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join cannot do a {how} join")
    on = list(on)
    hot = F.broadcast(hot_groups(left, on) if hot is None else hot.select(*on, "_salts"))
    salts = F.when(_any_null(on), F.lit(_partitions(left)).cast("bigint")).otherwise(F.coalesce("_salts", F.lit(1)))
    dealt = left.join(hot, on, "left").select(*left.columns, _deal(by, salts).alias("_salt"))
    repeated = right.join(hot, on, "left").select(
        *right.columns, F.explode(_numbers(F.col("_salts"))).alias("_salt")
    )
    return dealt.join(growing(repeated), [*on, "_salt"], how).drop("_salt")


def hot_pairs(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys with more work than a task's even share, and the grid to cut each into.

    A key's work is its pairs and the rows that are read for them, as a key may be missing on the other side.
    The side with more rows is cut into more parts, ``_p`` of the left and ``_q`` of the right.
    """
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.filter(~_any_null(on)).groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(name))

    one = F.lit(1.0)
    both = sizes(left, "_l").join(growing(sizes(right, "_r")), list(on), "full").fillna(0.0, ["_l", "_r"])
    both = both.withColumn("_n", F.col("_l") * F.col("_r") + F.col("_l") + F.col("_r"))
    total = both.agg(F.sum("_n").alias("n")).scalar()
    parts = _partitions(left)
    share = F.col("_n") * F.lit(parts) / total
    cells = F.ceil(share * CELLS_PER_TASK)
    square = F.ceil(F.sqrt(cells * F.col("_l") / F.greatest(one, F.col("_r"))))
    p = F.greatest(one, F.least(F.col("_l"), cells, square))
    hot = both.filter(share > 1).withColumn("_p", p.cast("bigint")).withColumn("_cells", cells)
    q = F.least(F.col("_r"), F.ceil(F.col("_cells") / F.col("_p")))
    return hot.select(*on, "_p", F.greatest(one, q).cast("bigint").alias("_q"))


def pair_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], by_left: Sequence[str], by_right: Sequence[str]
) -> DataFrame:
    """Inner equi-join whose pairs are dealt evenly even if one key has most of them.

    A hot key's left rows are cut into parts, its right rows too, and every part of one side meets
    every part of the other once, each meeting in a cell of its own. Cells of a key are of much the same size and go
    to a fixed number of tasks in turn: hashed to them, some tasks would have several times the cells of others, and
    Spark would merge tasks by the bytes they read, which are few however many pairs come of them.
    """
    on = list(on)
    tasks = _partitions(left)
    hot = F.broadcast(hot_pairs(left, right, on))
    one = F.lit(1).cast("bigint")
    p, q = F.coalesce("_p", one), F.coalesce("_q", one)
    rows = left.join(hot, on, "left").select(
        *left.columns, q.alias("_wide"), _deal(by_left, p).alias("_i"), F.explode(_numbers(F.col("_q"))).alias("_j")
    )
    others = right.join(hot, on, "left").select(
        *right.columns, q.alias("_wide"), _deal(by_right, q).alias("_j"), F.explode(_numbers(F.col("_p"))).alias("_i")
    )
    number = F.col("_i") * F.col("_wide") + F.col("_j")
    first = F.pmod(F.xxhash64(*on), F.lit(tasks).cast("bigint"))

    def dealt(df: DataFrame) -> DataFrame:
        known = df.filter(~_any_null(on)).withColumn("_cell", number).drop("_i", "_j", "_wide")
        known = known.withColumn("_task", F.pmod(first + F.col("_cell"), F.lit(tasks)).cast("int"))
        return known.repartitionById(tasks, "_task")

    return dealt(rows).join(growing(dealt(others)), [*on, "_cell", "_task"]).drop("_cell", "_task")
