"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that pass the first filter, as a multiple of the sample.
SPARE = 4


def bounded_sample(df: DataFrame, by: str, n: int) -> DataFrame:
    """At most ``n`` distinct rows: those whose ``by`` has the smallest hashes; the same rows every time.

    A filter on the hash, set by the approximate number of distinct values, leaves about SPARE * n
    values (or all, where there are fewer) before anything is sorted or sent, so no task gets more
    than that at any size of the table. Null values of ``by`` are left out.
    """
    h = F.xxhash64(by)
    values = df.agg(F.approx_count_distinct(h)).first()[0]
    part = min(1.0, SPARE * n / max(1, values))
    some = df.where(F.col(by).isNotNull() & (h <= min(2**63 - 1, -(2**63) + int(2**64 * part))))
    return some.distinct().orderBy(h, by).limit(n)
