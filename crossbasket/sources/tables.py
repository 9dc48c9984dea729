"""Table, mapping-file, datamart and metric sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.session import stage
from crossbasket.sources.schemas import UNIQUE_CUSTOMERS


def read_table(
    spark: SparkSession, name: str, cols: Sequence[str] | None = None
) -> DataFrame:
    """A catalog table by name, or a Parquet path (anything with a slash)."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df if cols is None else df.select(*cols)


MALFORMED = "_malformed"


def _plain_name(name: str) -> str:
    return "_".join(name.split()).lower()


def _mapping_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV lookup's declared columns, found by the names in its header, and the text of each malformed row."""
    header = [_plain_name(name) for name in spark.read.csv(path, header=True).columns]
    missing = [name for name in schema.fieldNames() if name not in header]
    if missing or any(header.count(name) > 1 for name in schema.fieldNames()):
        raise ValueError(f"{path} must have each column once: {', '.join(schema.fieldNames())}; it has {', '.join(header)}")
    declared = {f.name: f.dataType for f in schema.fields}
    # in the file's order, whatever else it holds
    fields = [T.StructField(f"_{i}", declared.get(name, T.StringType())) for i, name in enumerate(header)]
    # without column pruning whole rows are parsed, whatever columns a plan needs
    reader = spark.read.option("columnPruning", "false").options(
        header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    rows = reader.schema(T.StructType([*fields, T.StructField(MALFORMED, T.StringType())])).csv(path)
    columns = [F.col(f"_{header.index(name)}").alias(name) for name in schema.fieldNames()]
    # Spark reads the text of broken rows only beside other columns; this text of a row is never null
    named = F.to_json(F.struct(*[f.name for f in fields])).isNotNull()
    return rows.filter(named).select(*columns, MALFORMED)


def read_mapping(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV lookup with a header, read under a declared schema; its well-formed rows.

    Columns go by their names in the header, as ``snake_case`` makes them plain, in whatever order; others are
    left out, and a missing or repeated one is an error. Values are trimmed. Rows with too few or too many values, or
    with one that is not of the declared type, are in ``malformed_rows``.
    """
    rows = _mapping_rows(spark, path, schema).filter(F.col(MALFORMED).isNull()).drop(MALFORMED)
    text = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
    return rows.select([F.trim(c).alias(c) if c in text else F.col(c) for c in rows.columns])


def malformed_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The text of the rows that ``read_mapping`` leaves out: ``line``."""
    rows = _mapping_rows(spark, path, schema)
    return rows.filter(F.col(MALFORMED).isNotNull()).select(F.col(MALFORMED).alias("line"))


def snake_case(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower-cased and with underscores for blanks."""
    return df.toDF(*[_plain_name(name) for name in df.columns])


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV list of keys, all text, under the names of its header made plain."""
    return snake_case(spark.read.csv(path, header=True))


def mapping_with_codes(mapping: DataFrame, codes: DataFrame, on: str) -> DataFrame:
    """A mapping by code with the names of its codes; unknown codes keep a NULL name."""
    return mapping.join(codes, [on], "left")


def write_datamart(
    tables: Mapping[str, DataFrame],
    root: str,
    partition_by: Mapping[str, Sequence[str]] | None = None,
    at_once: int = 4,
) -> dict[str, DataFrame]:
    """Each table as a Parquet directory under ``root``, replaced if there; returns the scans
    of what was written.

    The writes are independent jobs; several run at a time so that the tail of one does not
    leave the cluster idle.
    """
    partition_by = partition_by or {}

    def write(name: str) -> DataFrame:
        return stage(tables[name], f"{root}/{name}", tuple(partition_by.get(name, ())))

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(tables, pool.map(write, tables)))


def read_datamart(
    spark: SparkSession,
    root: str,
    names: Iterable[str],
    schemas: Mapping[str, T.StructType] | None = None,
) -> dict[str, DataFrame]:
    """The named tables of a datamart, by declared schema where one is given, which needs no Spark job."""
    schemas = schemas or {}

    def load(name: str) -> DataFrame:
        schema = schemas.get(name)
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(f"{root}/{name}")
        return df if schema is None else df.select(*schema.fieldNames())

    return {name: load(name) for name in names}


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Temporary views of the same names, for use from SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A (pair, n) frame as JSON lines, replaced if there."""
    metrics.select(*UNIQUE_CUSTOMERS.fieldNames()).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNIQUE_CUSTOMERS).json(path)
