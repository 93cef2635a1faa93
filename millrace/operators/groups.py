"""Numbers, running sums and previous values inside groups of any size.

``row_number``, running ``sum`` and ``lag`` over PARTITION BY key put a whole group into one task.
Where the largest group is small enough for that, this is the plan. Otherwise rows are range-
partitioned by (key, order), so that a large group lies in several partitions; the windows run
inside (key, partition), and one row for each of those carries count, sum and last value over to
the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

#: Rows that a group may have to be one task's work.
GROUP_ROWS = 2_000_000


def along(df: DataFrame, key: str, order: Sequence[str], *, number: str | None = None, total: tuple[str, str] | None = None, previous: tuple[str, str] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` with, inside each group of ``key`` in ascending ``order`` (total, nulls first):

    ``number``: a column of 1..n; ``total``: (column, name) a running sum; ``previous``: (column,
    name) the value of the row before, NULL at the first. Null keys are a group. An empty table
    stays empty. The result does not depend on ``group_rows``.
    """
    most = df.count()  # of files, that reads no column; groups are only counted where one can be too large
    if most > group_rows:
        most = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= group_rows:
        w = Window.partitionBy(key).orderBy(*order)
        if number:
            df = df.withColumn(number, F.row_number().over(w).cast("long"))
        if total:
            df = df.withColumn(total[1], F.sum(total[0]).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        if previous:
            df = df.withColumn(previous[1], F.lag(previous[0]).over(w))
        return df
    rows = cut(df.repartitionByRange(key, *order).withColumn("__p", F.spark_partition_id()))
    w = Window.partitionBy(key, "__p").orderBy(*order)
    parts = rows.groupBy(key, "__p").agg(
        F.count(F.lit(1)).alias("__n"),
        (F.sum(total[0]) if total else F.lit(None)).alias("__s"),
        (F.max_by(F.struct(previous[0]), F.struct(*order)) if previous else F.lit(None)).alias("__l"),
    )
    over = Window.partitionBy(key).orderBy("__p")  # one row for each part of a group
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col(key).alias("__k"), F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.sum("__s").over(before).alias("__s") if total else F.lit(None).alias("__s"), F.lag("__l").over(over).alias("__l")
    )
    first = Window.partitionBy(key, "__p").orderBy(*order)
    out = rows.withColumn("__r", F.row_number().over(first))
    if total:
        out = out.withColumn("__t", F.sum(total[0]).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if previous:
        out = out.withColumn("__v", F.lag(previous[0]).over(w))
    out = out.join(carried, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q")))
    added = []
    if number:
        added.append((F.col("__n") + F.col("__r")).cast("long").alias(number))
    if total:
        added.append(F.when(F.col("__t").isNull(), F.col("__s")).when(F.col("__s").isNull(), F.col("__t")).otherwise(F.col("__s") + F.col("__t")).alias(total[1]))
    if previous:
        added.append(F.when(F.col("__r") == 1, F.col("__l")[previous[0]]).otherwise(F.col("__v")).alias(previous[1]))
    return out.select(*df.columns, *added)
