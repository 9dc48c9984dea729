"""Helpers for Arrow batches inside tasks."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# text handled at once in a task; one longer text is handled alone
PIECE_BYTES = 1 << 20
# what an Arrow batch may hold, unless one row is larger: it stands in memory several times
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once an application, unless they have it by the path
    they share with the driver (or it was submitted as a file itself)."""
    application = spark.sparkContext.applicationId
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    parent = os.path.dirname(package)
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if application in _SHIPPED or parent in known or not os.path.isdir(package):
        return
    target = os.path.join(tempfile.mkdtemp(), os.path.basename(package))
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", parent, os.path.basename(package)))
    _SHIPPED.add(application)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` on executors that know this package, in batches of bounded size.

    Lowers the session's limit on the bytes of a batch to ``BATCH_BYTES`` if it is higher.
    """
    spark = df.sparkSession
    _ship(spark)
    limit = str(spark.conf.get(_BATCH_SETTING)).lower().removesuffix("b")
    if not limit.isdigit() or not 0 < int(limit) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def texts(column: pa.Array) -> list[str]:
    """The column's texts, null as empty."""
    return [text or "" for text in column.to_pylist()]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts take about ``limit`` bytes together."""
    sizes = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < batch.num_rows:
        yield batch.slice(first)
