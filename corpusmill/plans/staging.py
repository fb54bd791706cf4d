"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` as the cluster names it.

    Only where the setting is absent and the master is local, a temporary folder takes its place.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def until_end(spark: SparkSession, path: str) -> str:
    """`path`, which is there and goes when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back.

    A written table is read by column, is compressed, and does not depend on any executor. It is
    deleted when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "staged")
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(until_end(spark, path))


#: Rows and bytes of whole texts that a Python worker gets at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def text_batches(docs: DataFrame) -> DataFrame:
    """`docs`, after the session's Arrow batches have been bounded for rows that hold whole texts.

    The default of 10,000 rows suits numbers; with long texts such a batch, its copies in the JVM
    and the worker, and the result would take much of an executor's memory. Smaller settings stay.
    """
    conf = docs.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key, str(most)).removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return docs
