"""Row numbers and dense ranks over a whole table without a single-task window.

A window without PARTITION BY moves every row into one task. Here rows are range-partitioned and
sorted, numbered inside their partition, and shifted by the sizes of the partitions before (one
small row for each partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """``df`` with a column of numbers 1..n in the given order (total, or ties fall in any order)."""
    shuffled = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = shuffled.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n")).collect()  # one row for each partition
    before, rows = 0, []
    for p, n in sorted((r["__p"], r["__n"]) for r in sizes):
        rows.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "__p long, __before long")
    within = F.col("__at") - F.shiftleft(part, 33) + 1
    return shuffled.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__before") + within).cast("long")).drop("__p", "__before", "__at")


def dense_ranks(df: DataFrame, column: str, name: str = "group_id") -> DataFrame:
    """``df`` with the dense rank of ``column`` (nulls first): distinct values are numbered, then joined back."""
    ids = number_rows(df.select(column).distinct(), [F.col(column).asc()], name)
    return df.alias("d").join(ids.alias("i"), F.col(f"d.{column}").eqNullSafe(F.col(f"i.{column}"))).select("d.*", f"i.{name}")
