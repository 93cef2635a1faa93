"""Working folders that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from millrace.session import local_folder


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs on one machine (tests) it lies in a temporary folder.
    """
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else local_folder(spark))
    return f"{base}/work-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()
