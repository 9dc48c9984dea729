"""What the operators of this package have in common: input tables and written stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossbasket.session import delete_folder, scratch, stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder under the shared one and read back.

    Cuts the lineage there: executors lost later cost no earlier stage, and what is not
    repeatable (partition numbers, generated ids) is fixed from then on.
    """
    return stage(df, f"{scratch(df.sparkSession)}/{name}")


class Room:
    """Tables of one computation under the shared folder, which go as soon as nothing needs them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, scratch(spark)
        self._held: dict[int, tuple[DataFrame, str]] = {}
        self._number = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As ``written``."""
        self._number += 1
        path = f"{self.root}/{self._number}-{name}"
        out = stage(df, path)
        self._held[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that ``write`` returned; nothing may be computed from them afterwards."""
        for table_ in tables:
            _, path = self._held.pop(id(table_), (None, None))
            if path:
                delete_folder(self.spark, path)


def fold_case(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint where ``rows``, the counted size of ``df``, is within ``limit``."""
    return F.broadcast(df) if rows <= limit else df
