"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Every input partition is a block. A block's rows are put into random order where they are, a
matrix says how many rows of each block go to each shard, and the rows are dealt accordingly: the
first rows of the order to shard 0, the next to shard 1 and so on. The matrix is drawn as the
counts of a uniform random arrangement: row by row a multivariate hypergeometric draw from what
room the shards have left. After the exchange each shard is permuted again. DataFrame functions
do all work on rows; the driver draws the matrix, of at most ``MAX_BLOCKS`` rows.

A shard may be far larger than a task should hold, so the second permutation cuts it into cells
by random key; a row's slot is its rank in the cell plus the sizes of the cells before. No step
groups by a column of the input, hence equal ids or texts land in no task together.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm.shared import written

SHARDS = 40
MAX_BLOCKS = 4096
CELL_ROWS = 200_000
_INDEX_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good; exact inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each block for each shard; columns add up to shard sizes at most one apart."""
    rng = random.Random(seed)
    total = sum(blocks)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for size in blocks:
        row, left, others = [], size, sum(room)
        for j in range(shards):
            others -= room[j]
            row.append(hypergeometric(rng, room[j], others, left))
            left -= row[j]
        room = [a - b for a, b in zip(room, row)]
        matrix.append(row)
    return matrix


def uniform_shards(
    rows: DataFrame, shards: int = SHARDS, seed: int = 1, max_blocks: int = MAX_BLOCKS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Every row of the input is in the result once, whatever its values: nulls and repeated rows
    are rows like any other. The columns ``shard`` and ``slot`` of the input, if any, are replaced. An
    empty input gives an empty result; with fewer rows than shards some shards stay empty.
    """
    names = [name for name in rows.columns if name not in ("shard", "slot")]
    packed = rows.coalesce(max_blocks).select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("row"))
    # block and place are part of the key: rows that are equal are dealt like any others
    order = packed.withColumn("_place", F.monotonically_increasing_id()).sortWithinPartitions(
        F.xxhash64(F.lit(seed), "_place", "row"), "_place"
    )
    packed = order.select("row")
    placed = written(packed.select("row", F.monotonically_increasing_id().alias("_at")), "blocks")

    block = F.shiftright("_at", _INDEX_BITS).cast("int")
    counted = placed.groupBy(block.alias("_block")).count().collect()  # at most max_blocks rows
    sizes = sorted((row["_block"], row["count"]) for row in counted)
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    ends = []
    for (number, _), row in zip(sizes, matrix):
        total, upto = 0, []
        for n in row:
            total += n
            upto.append(total)
        ends.append((number, upto))
    schema = T.StructType([T.StructField("_block", T.IntegerType()), T.StructField("_ends", T.ArrayType(T.LongType()))])
    limits = F.broadcast(rows.sparkSession.createDataFrame(ends, schema))

    place = F.col("_at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    dealt = placed.withColumn("_block", block).join(limits, "_block").select(
        "row", "_at",
        F.size(F.filter("_ends", lambda e: e <= place)).alias("shard"),
        F.xxhash64(F.lit(seed + 1), F.col("_at")).alias("_key"),
    )
    cells = max(1, math.ceil(sum(n for _, n in sizes) / shards / cell_rows))
    unit = (F.col("_key").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    cell = F.least(F.floor(unit * cells), F.lit(cells - 1)).cast("int")
    dealt = dealt.withColumn("_cell", cell)
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(
        "shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("shard", "_cell").orderBy("_key", "_at")
    ranked = dealt.withColumn("_rank", F.row_number().over(within)).join(offsets, ["shard", "_cell"])
    return ranked.select("row.*", "shard", (F.col("_before") + F.col("_rank") - 1).alias("slot"))


def report(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Id, size and checksum of each document with the shard and slot it is dealt to.

    A null text counts as no bytes. Other columns are ignored.
    """
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    rows = documents.select(
        "doc_id", (F.octet_length(data) + 16).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")
    )
    return uniform_shards(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
