"""Session settings the library relies on, and where it may write intermediate data."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC; the zone is a session setting that any caller may have left elsewhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir`` of the cluster; where that is unset, below the
    warehouse, which driver and executors share too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def job_of(df, default: str = "manual") -> str:
    """Id of the streaming query that runs this micro-batch. It belongs to the checkpoint, so it is the same after a
    restart and another one for a fresh checkpoint."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or default


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) pair for metadata operations: exists, list, delete."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = hadoop_path(spark, path)
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, jpath = hadoop_path(spark, path)
    fs.delete(jpath, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct children of a folder (file-system metadata, no data read)."""
    fs, jpath = hadoop_path(spark, path)
    if not fs.exists(jpath):
        return []
    return [status.getPath().getName() for status in fs.listStatus(jpath)]
