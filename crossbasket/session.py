"""Session settings and the shared folder used for tables written between stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join input even if a later step then needs its own shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # call sites for error messages double the time it takes to put a plan together
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def build_session(app: str = "crossbasket", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` uses ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, one process that does all work itself takes a folder of the warehouse; on a cluster that
    could be a folder of the driver's machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/crossbasket-stages"
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)


def folder_state(spark: SparkSession, path: str) -> str:
    """Changes when files below ``path`` are added, removed or replaced: time, number and size. No Spark job."""
    where, files = _file_system(spark, path)
    whole = files.getContentSummary(where)
    return f"{files.getFileStatus(where).getModificationTime()}:{whole.getFileCount()}:{whole.getLength()}"


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text, None if there is none. No Spark job."""
    where, files = _file_system(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> str:
    """Puts a small file there as a whole and returns what is there afterwards: it appears by a renaming, so that
    no one ever reads a part of it, and where another was earlier that one may stay."""
    part, files = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    where, _ = _file_system(spark, path)
    if not files.rename(part, where):
        files.delete(part, False)
    return read_text(spark, path)


def scratch(spark: SparkSession) -> str:
    """A new folder of its own for tables of this application."""
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/crossbasket/{application}/{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet and return a scan of what was written.

    Unlike a cached frame this survives lost executors, and unlike a checkpointed one
    later plans still prune its columns and partitions. Rows for the same folder are gathered
    into files of even size first, so that not every task writes one for every folder.
    """
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
