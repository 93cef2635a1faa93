"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the directory, scanned lazily (filters and columns reach the scan)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """Registers the tables as temporary views of the same names, for SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark
