"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "gleanspark", cpus: int | None = None) -> SparkSession:
    """A session for tests and benchmarks; on a cluster pass your own session to the operators."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if not os.environ.get("SPARK_MASTER"):
        n = cpus or os.cpu_count() or 4
        builder = builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.memory", os.environ.get("GLEAN_DRIVER_MEMORY", "4g"))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir``. In local mode, where none is set, a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleanspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/gleanspark-{name}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> str:
    """Have what is at ``path`` removed when the driver's file system client closes."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    :func:`discard` removes the files; else they go when the driver's file system client closes.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    # No file that marks success: a local file system starts processes of the driver for each.
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table made by :func:`stored` that nothing will read again."""
    path = getattr(df, "_stored_path", None)
    if path:
        spark = df.sparkSession
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
