"""Session builder and lineage helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the library expects (UTC, AQE on)."""
    b = (
        SparkSession.builder.master(master)
        .appName("millrace")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def local_folder(spark: SparkSession) -> str:
    """A temporary folder of this machine, where Spark runs on this machine alone; an error elsewhere."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="millrace-")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: cuts lineage, so that several jobs read one result.

    Files go to the folder that the cluster names in ``spark.checkpoint.dir``; only where that is
    unset and Spark runs on one machine (tests) a temporary folder is set. They are deleted when the
    result is no longer referenced, unless the session says otherwise.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark))
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A scan over enough partitions for the cores there are.

    Small files give one partition, and a Python operator would then run in one task. Rows are
    dealt out only where that at least doubles the tasks; a scan of many splits stays as it is,
    without a shuffle. Not for plans with a shuffle (they would run here).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
